"""SPARQL 1.2 text to syntax trees."""
