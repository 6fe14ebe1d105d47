"""Operators over feature tables: filters, queries, joins, aggregates, tiles, themes, rasters."""
