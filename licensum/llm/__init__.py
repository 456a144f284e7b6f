"""Operators for the preparation of training text, one module each; their queries are in ``queries``."""
