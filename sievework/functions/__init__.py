"""Column builders: text forms, safety patterns, labels, numbers."""
