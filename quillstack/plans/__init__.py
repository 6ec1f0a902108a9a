"""Archives projected from general tables, and checks of sizes."""
