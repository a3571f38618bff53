"""Operators over node, link and text tables."""
