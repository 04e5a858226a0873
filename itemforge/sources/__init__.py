"""Readers of the question bank."""
