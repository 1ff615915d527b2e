"""Operators as DataFrame transformations: hits, events, clusters, tracks, matching, efficiency, timing, scope, alignment, QA."""
