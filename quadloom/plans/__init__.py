"""Syntax trees to DataFrame plans."""
