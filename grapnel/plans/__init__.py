"""Grapnel plans."""
