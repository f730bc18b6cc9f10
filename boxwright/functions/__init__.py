"""Box schemas and column expressions: predicates, distances, measures."""
