"""Evidence retrieval, claim verification and corpus analytics on Spark DataFrames."""
