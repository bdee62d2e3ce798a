"""Feature preparation, model training and evaluation as Spark jobs."""
