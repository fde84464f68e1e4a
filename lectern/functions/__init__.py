"""Column expressions: text clean-up, HTML extraction, names, rule dialect."""
