"""quarryline: hybrid text retrieval and corpus processing as Spark plans."""
