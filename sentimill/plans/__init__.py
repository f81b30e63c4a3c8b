"""Queries over the given tables, each beside the SQL that states its result."""

from sentimill.plans import entities, facts, headlines, markets, payloads, readings, signals, texts, tone

QUERIES = {**tone.QUERIES, **markets.QUERIES, **texts.QUERIES, **facts.QUERIES, **signals.QUERIES, **readings.QUERIES, **headlines.QUERIES, **entities.QUERIES, **payloads.QUERIES}
ORACLES = {**tone.ORACLES, **markets.ORACLES, **texts.ORACLES, **facts.ORACLES, **signals.ORACLES, **readings.ORACLES, **headlines.ORACLES, **entities.ORACLES, **payloads.ORACLES}
