"""The index life cycle, the query engine, and graphs derived from tables."""
