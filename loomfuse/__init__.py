"""loomfuse: schema matching, record linkage and table fusion as Spark DataFrame plans."""
