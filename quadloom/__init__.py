"""quadloom: graph-pattern analytics as Spark DataFrame plans."""
