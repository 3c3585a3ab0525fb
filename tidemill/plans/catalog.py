"""All queries of the reference workload on the driver tables."""

from tidemill.plans import calendar, claims, entities, folding, intake, lineups, matches, moves, news, observations, outlets, ranking, records, relations, runs, scalars, streams, tables, titles, verification, views  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES  # noqa: F401
