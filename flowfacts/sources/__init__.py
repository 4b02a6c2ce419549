"""Readers that turn files into fact tables, and report sinks."""
