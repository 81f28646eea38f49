"""Column functions: text, identifiers, vectors, boxes."""
