"""All queries by name, with their SQL."""

from __future__ import annotations

from ledgerline.plans import audits, figures, queue, records, relational, requests, reviews, stores, texts
from ledgerline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "figures", "queue", "records", "relational", "requests", "reviews", "stores", "texts"]
