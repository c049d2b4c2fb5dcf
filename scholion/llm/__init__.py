"""Operators for preparing training data; nothing else in the library imports this subpackage."""

MODULES = ["canonical_queries", "fusion_queries", "entities_queries", "scans_queries", "splitting_queries", "people_queries", "packing_queries", "mixing_queries", "language_queries"]
