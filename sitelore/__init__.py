"""Website knowledge and retrieval as Spark jobs."""
