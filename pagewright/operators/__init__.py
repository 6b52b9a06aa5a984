"""Table operators: filters, joins, aggregates, windows, sets and page functions."""
