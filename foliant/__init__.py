"""foliant: corpus, retrieval and curriculum analytics expressed as PySpark DataFrames."""
