"""From a grammar and a schema to a boolean column: plain predicates, or an automaton over Arrow batches."""
