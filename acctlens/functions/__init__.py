"""Column expressions: risk rules, text formats, addresses, code tables."""
