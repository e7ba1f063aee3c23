"""Column functions: text, similarity, identifiers, statistics."""
