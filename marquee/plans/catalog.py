"""All event-listing queries; importing the modules registers them."""

from __future__ import annotations

from marquee.plans import billings, crawls, elements, fields, importing, lists, quality, records, searching, streams, versions
from marquee.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "billings", "crawls", "elements", "fields", "importing", "lists", "quality", "records", "searching", "streams", "versions"]
