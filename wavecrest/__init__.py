"""Signal and token analytics as Spark operators."""
