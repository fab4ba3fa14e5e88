"""Where triples come from: quad tables, mapped relational tables, files."""
