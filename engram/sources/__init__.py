"""Readers, stored tables and outside providers."""
