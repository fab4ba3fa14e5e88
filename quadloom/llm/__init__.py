"""Operators for preparing training text at scale; nothing else in quadloom imports this package."""
