"""Whole pipelines, their configuration, and the catalogue of registered queries."""
