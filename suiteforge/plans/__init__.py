"""Composite plans (curation, evolution rounds) and the registered query catalog."""
