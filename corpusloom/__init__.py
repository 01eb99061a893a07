"""corpusloom: retrieval-corpus and training-corpus operators as Spark DataFrame jobs."""
