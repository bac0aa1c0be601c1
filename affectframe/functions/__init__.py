"""Column functions: text, predicates, dates and score vectors."""
