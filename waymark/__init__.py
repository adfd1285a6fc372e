"""Waymark: spatial nearest-feature, provenance and corpus analytics on PySpark."""
