"""Road-segment analytics as Spark DataFrame transformations."""
