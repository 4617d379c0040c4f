"""Personal-data, layout and corpus analytics as Spark DataFrame operators."""
