"""Operators for preparing training text: filters, joins, deduplication, counting, archives and mixing."""
