"""Readers: books in XML, archives of them, style sheets."""
