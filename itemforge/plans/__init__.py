"""Queries made of the operators."""

from . import items, keys, layouts, pages, queries, wholes  # noqa: F401  each registers its queries
