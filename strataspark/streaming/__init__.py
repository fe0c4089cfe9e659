"""Incremental pick-up of newly landed databases."""
