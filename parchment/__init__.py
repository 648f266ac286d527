"""Document extraction and its evaluation as Spark jobs."""
