"""Operators for cleaning and tokenising large text corpora."""
