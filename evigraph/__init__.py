"""Near-duplicate detection and relationship analytics over large libraries, on PySpark."""
