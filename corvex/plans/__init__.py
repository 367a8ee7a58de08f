"""Registered queries, by family."""

from . import graph, knowledge, lifecycle, search, structure, usage  # noqa: F401
