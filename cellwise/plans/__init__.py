"""Compositions: the batch analysis, and the registered queries."""
