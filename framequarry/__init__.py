"""A Spark-first engine for retrieval analytics over media catalogues."""
