"""Analytics operators as Spark DataFrame plans."""
