"""Column expressions: colour codes, colour maths, small parsers."""
