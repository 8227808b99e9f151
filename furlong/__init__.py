"""A Spark-first racing analytics engine with operators for training-data pipelines."""
