"""A Spark-first analytics engine for ordered datasets."""
