"""Bindings of the given tables to the catalogue roles, and the registered queries."""
