"""Operators of a training-data pipeline over text and vectors. Nothing else in the library imports this subpackage."""
