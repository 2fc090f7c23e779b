"""Siltstone: document ingestion and cited retrieval over Spark DataFrames."""
