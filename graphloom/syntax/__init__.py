"""Recursive-descent parsers of ten languages over one lexer; see base.py."""
