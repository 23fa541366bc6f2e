"""Column expressions of names and paths, each with a plain Python twin."""
