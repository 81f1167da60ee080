"""Compositions of operators, adapter views over the test tables, and the query registry."""
