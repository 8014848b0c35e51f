"""A PySpark engine for content-addressed file repositories."""
