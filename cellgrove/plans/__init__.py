"""Intermediate tables, parameters and the registered queries."""
