"""Lodestone: document-retrieval analytics expressed as Spark DataFrame plans."""
