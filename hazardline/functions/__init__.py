"""Column functions: text, numeric and vector expressions. No Python UDFs here."""
