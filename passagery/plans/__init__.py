"""Composed retrieval pipelines and the registered queries."""
