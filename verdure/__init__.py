"""Environmental time-series analytics expressed as Spark DataFrame operators."""
