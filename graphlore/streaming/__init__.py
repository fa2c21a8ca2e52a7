"""streaming of the retrieval engine."""
