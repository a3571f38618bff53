"""Streams of new book files and of reading events."""
