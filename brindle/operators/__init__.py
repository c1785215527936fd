"""Relational building blocks: queries, joins, paging, grouping, patching."""
