"""Structure analytics over software property graphs, expressed as Spark plans."""
