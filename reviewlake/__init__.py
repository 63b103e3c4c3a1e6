"""Change-review analytics as Spark DataFrame operators."""
