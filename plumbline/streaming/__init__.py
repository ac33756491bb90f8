"""Incremental variants of batch plans."""
