"""Item-recommendation analytics as Spark DataFrame operators."""
