"""sources of the retrieval engine."""
