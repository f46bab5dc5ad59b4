"""decisa: decision-data analytics as Spark DataFrame operators."""
