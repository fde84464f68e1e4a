"""DataFrame steps: titles, rules, numbering, joins, audio manifest."""
