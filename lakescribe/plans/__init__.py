"""Compositions of operators: discovery, publication, comparison of whole snapshots."""
