"""Readers, row contracts, result writers and the generation store."""
