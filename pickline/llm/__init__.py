"""Operators for preparing training text, each by its own method; see ``registry``."""
