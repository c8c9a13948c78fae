"""Findings, summaries, reads and reports built from the operators."""
