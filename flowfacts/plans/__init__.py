"""Whole analyses, put together from sources, facts, operators and sinks."""
