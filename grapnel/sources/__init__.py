"""Grapnel sources."""
