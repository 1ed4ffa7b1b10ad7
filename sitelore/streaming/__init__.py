"""Incremental (micro-batch) forms of the indexing and logging jobs."""
