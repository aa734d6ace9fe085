"""Column functions: text, dates, numbers and market formulas."""
