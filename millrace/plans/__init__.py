"""Queries over the given tables."""

from . import registry, logs, more  # noqa: F401, I001 - logs and more add their queries to registry
