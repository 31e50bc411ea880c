"""driftline: pipeline observability, root-cause ranking and corpus preparation as Spark jobs."""
