"""Every registered query of the engine and the SQL that it equals."""

from __future__ import annotations

from girder.plans import documents, drawings, evaluation, lookups, networks, pricing, quantities, reading, relational, replays, takeoff, textual  # noqa: F401  each notes its queries down
from girder.plans.registry import ORACLES, QUERIES  # noqa: F401
