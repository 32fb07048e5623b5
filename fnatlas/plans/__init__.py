"""Composite plans: derived relations, the query catalog, the whole pipeline, inference on files."""
