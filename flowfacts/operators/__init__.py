"""Operators over fact tables: fixpoints, graphs, joins, sets and verdicts."""
