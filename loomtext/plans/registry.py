"""All registered queries of the engine's own operators and their DuckDB equivalents, grouped by phase."""

from __future__ import annotations

from loomtext.plans import corpus, kernels, tokens

QUERIES = corpus.QUERIES | tokens.QUERIES | kernels.QUERIES
ORACLES = corpus.ORACLES | tokens.ORACLES | kernels.ORACLES
