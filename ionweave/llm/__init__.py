"""Operators for large-scale training-data pipelines.

Nothing else in ``ionweave`` imports this subpackage; it can be removed whole.
"""
