"""All queries of the curation engine, and their SQL."""

from tessera.queries import match, messages, store, text  # noqa: F401  registering
from tessera.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
