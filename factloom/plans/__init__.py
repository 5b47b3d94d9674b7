"""Queries and their SQL."""

from . import cases, client_queries, fields, provider_queries, queries, review_queries  # noqa: F401
