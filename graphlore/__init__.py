"""Knowledge-graph retrieval analytics expressed as Spark DataFrame plans."""
