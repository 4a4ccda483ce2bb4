"""Evidence analytics as Spark DataFrame transformations."""
