"""Registered queries by name."""

from ledgerloom.plans import documents, feeds, relational

QUERIES = {**documents.QUERIES, **relational.QUERIES, **feeds.QUERIES}
