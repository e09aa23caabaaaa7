"""Bindings of the operators to the test tables, and the query registry."""
