"""Column expressions: text helpers, record rendering, scoring, similarity."""
