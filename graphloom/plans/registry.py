"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import catalogue, files, forms, oracles

QUERIES = {**catalogue.QUERIES, **files.QUERIES, **forms.QUERIES}
ORACLES = {**oracles.ORACLES, **files.ORACLES, **forms.ORACLES}
