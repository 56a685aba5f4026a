"""All registered queries of the core library."""

from docloom.plans import answers, catalog, chunking, documents, files, lifecycle, managed, metadata, providers, repairs  # noqa: F401  they register their queries
from docloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
