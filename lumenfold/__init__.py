"""lumenfold: a Spark-first relational and sketch engine."""
