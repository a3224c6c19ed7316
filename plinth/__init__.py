"""plinth: a Spark-first engine for capital-program snapshots, places, rules and training data."""
