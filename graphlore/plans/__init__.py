"""plans of the retrieval engine."""
