"""Validation of micro-batches."""
