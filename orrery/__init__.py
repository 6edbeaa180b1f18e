"""orrery: vector search, clustering and data preparation as Spark DataFrame plans."""
