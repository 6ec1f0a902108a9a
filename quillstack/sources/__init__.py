"""Reading and writing archives."""
