"""DataFrame operators: cleaning, joins, aggregates, windows, scenarios, quality, routing."""
