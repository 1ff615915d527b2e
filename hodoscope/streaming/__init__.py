"""Event building over unbounded hit streams."""
