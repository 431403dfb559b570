"""All queries of the chunking operators by name, and the SQL that gives the same rows."""

from loam.plans import chunks, core, signal, streams, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (core, signal, text, chunks, streams):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
