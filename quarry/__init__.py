"""quarry: full-text search, ranking and keyword analytics on PySpark."""
