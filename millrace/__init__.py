"""millrace: a Spark-first engine for preparing and evaluating instruction data."""
