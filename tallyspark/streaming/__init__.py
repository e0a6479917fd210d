"""Micro-batch use of the batch upsert."""
