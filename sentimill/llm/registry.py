"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from sentimill.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = queries.ORACLES
