"""plumbline: document evidence analytics as Spark DataFrame transformations."""
