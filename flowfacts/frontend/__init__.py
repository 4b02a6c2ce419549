"""Python source files as fact tables: one parse a file, relations for everything after it."""
