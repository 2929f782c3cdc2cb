"""presswire: Spark jobs for news and document corpora."""
