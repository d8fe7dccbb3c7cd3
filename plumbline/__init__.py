"""Evidence retrieval, citation verification and corpus preparation on PySpark."""
