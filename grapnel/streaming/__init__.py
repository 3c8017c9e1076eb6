"""Grapnel streaming."""
