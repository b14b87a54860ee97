"""Question answering and retrieval analytics as Spark DataFrame transformations."""
