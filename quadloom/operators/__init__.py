"""Graph operators beside queries: closures, set operations, validation, rules."""
