"""Registered queries, one per operator or family of operators."""
