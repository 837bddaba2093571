"""Column expressions: fixed values, money arithmetic, categorisation, scoring, text extraction."""
