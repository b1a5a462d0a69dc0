"""Relational operators: index building, querying, graph and multiset algebra."""
