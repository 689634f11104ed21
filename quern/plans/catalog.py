"""Queries of the sketch operators and the SQL that gives the same rows."""

from __future__ import annotations

from quern.plans import measures, searches, sets, streams, updates

QUERIES = sets.QUERIES | measures.QUERIES | updates.QUERIES | streams.QUERIES | searches.QUERIES
ORACLES = sets.ORACLES | measures.ORACLES | updates.ORACLES | streams.ORACLES | searches.ORACLES
