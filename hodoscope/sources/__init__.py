"""Readers of run inputs and canonical tables, and writers of results."""
