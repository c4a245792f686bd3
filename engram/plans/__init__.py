"""Composed plans: retrieval, consolidation, and the catalogue of queries."""
