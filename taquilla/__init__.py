"""Football ticketing analytics as Spark DataFrame operators."""
