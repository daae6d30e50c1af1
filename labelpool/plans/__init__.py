"""Composite plans: preparation, rounds, the loop, and the query catalog."""
