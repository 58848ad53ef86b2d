"""Measures and findings of one file as column expressions."""
