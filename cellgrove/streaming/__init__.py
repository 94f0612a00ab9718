"""Incremental grids."""
