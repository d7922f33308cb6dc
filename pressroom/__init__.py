"""News curation at scale, written as Spark DataFrame operations."""
