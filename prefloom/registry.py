"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from .plans import features, graph, history, models, popularity, samples, similarity, splits, texts
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "features", "graph", "history", "models", "popularity", "samples", "similarity", "splits", "texts"]
