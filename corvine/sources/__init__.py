"""Readers and writers for the document pipeline."""
