"""All queries of the library by name, with the SQL they are held against."""

from __future__ import annotations

from tallyforge.operators import audits, contamination, evaluation, generation, invariants, json_documents, maturity, probes, prospects, resampling, scorer, seeded, settings_scores, statistics, task_audits, verdicts

_PARTS = (contamination, statistics, evaluation, scorer, audits, resampling, invariants, probes, generation, prospects, verdicts, settings_scores, json_documents, seeded, task_audits, maturity)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
