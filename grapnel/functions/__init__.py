"""Grapnel functions."""
