"""Network-flow threat analytics as Spark DataFrame operators."""
