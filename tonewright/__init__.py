"""Opinion mining over annotated text, expressed as Spark DataFrame plans."""
