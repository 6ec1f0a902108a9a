"""Analytics over large archives of handwritten notes, on Spark."""
