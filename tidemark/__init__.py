"""tidemark: retrieval, evaluation and text analytics as Spark plans."""
