"""Enrichment, checks, sampling and attempt windows."""
