"""Decision-data analytics expressed as Spark DataFrame transformations."""
