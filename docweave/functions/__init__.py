"""Column functions: identities, text rules, citations, vectors."""
