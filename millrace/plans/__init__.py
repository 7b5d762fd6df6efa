"""The registered queries: each plan with the SQL that gives the same rows."""

from __future__ import annotations

from millrace.plans import aggregates, extensions, extras, formats, joins, ordered, reports, scalars, selections, streams, windows
from millrace.plans.registry import joined

QUERIES, ORACLE_SQL = joined([m.R for m in (reports, selections, joins, aggregates, windows, ordered, scalars, formats, extensions, extras, streams)])
