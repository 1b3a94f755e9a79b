"""Column functions: text rules, behavior rules, vectors."""
