"""All registered queries (importing the query modules fills the registry)."""

from . import consumer_queries, detail_queries, io_queries, journey_queries, metric_queries, ml_queries, stream_queries, panel_queries, portfolio_queries, record_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
