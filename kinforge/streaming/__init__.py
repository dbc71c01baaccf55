"""Checks of arriving batches."""
