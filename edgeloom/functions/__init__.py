"""Column expressions: text rules, untyped payload access, ids and page arithmetic."""
