"""Relational and vector operators built from DataFrame plans."""
