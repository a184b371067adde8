"""Catalogue analytics on Spark: keyed merges, spatial joins, skew-proof rollups and audits."""

__version__ = "0.1.0"
