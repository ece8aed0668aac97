"""Sales analytics over a retail star schema, written as Spark DataFrame plans."""
