"""Short-read chromatin analytics expressed as Spark DataFrame plans."""
