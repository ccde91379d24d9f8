"""Document-layout reconstruction as Spark DataFrame transforms."""
