"""The catalog of queries over the driver's tables."""

from . import document_queries, qa_queries, record_queries, span_queries, stream_queries, vector_queries  # noqa: F401
from .catalog import CATALOG


def all_queries() -> dict:
    return dict(CATALOG)
