"""The operators: parse a grammar, filter a frame by it, mark its valid rows."""
