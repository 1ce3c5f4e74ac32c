"""Citation and document-integrity analytics as Spark jobs."""
