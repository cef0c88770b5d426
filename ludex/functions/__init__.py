"""Column expressions: cleaning rules and tokenising."""
