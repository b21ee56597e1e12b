"""Word-level reading data on Spark: ingest, standardise, score, merge and model."""
