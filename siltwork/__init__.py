"""siltwork: corpus ingestion, maintenance, retrieval, graph analytics, evaluation and event streams on Spark DataFrames."""
