"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import extras, further, intervals, measures, rhythms, sequences

_ALL = {**sequences.QUERIES, **intervals.QUERIES, **measures.QUERIES, **rhythms.QUERIES, **extras.QUERIES, **further.QUERIES}

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
