"""Relational operators: filters, columns, joins, aggregates, ordering."""
