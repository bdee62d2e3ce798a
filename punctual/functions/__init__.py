"""Column functions: every one takes and returns a Spark ``Column``."""
