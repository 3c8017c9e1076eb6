"""Grapnel operators."""
