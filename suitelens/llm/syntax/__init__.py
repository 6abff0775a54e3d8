"""Table-driven parsers for the languages of source files."""
