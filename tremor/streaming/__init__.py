"""Continuous refresh of the graph's tables."""
