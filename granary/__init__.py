"""A PySpark engine that turns semi-structured pages and records into a clean, searchable, publishable catalog."""
