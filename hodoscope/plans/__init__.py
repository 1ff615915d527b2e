"""Plug-in registries, stage plans, and the catalogue of queries."""
