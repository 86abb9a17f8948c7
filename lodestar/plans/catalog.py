"""All queries outside the training-data subpackage."""

from __future__ import annotations

from lodestar.plans import contracts, corpus, evaluation, experiments, files, retrieval, textual
from lodestar.plans.registry import Registry

REGISTRY = Registry()
for part in (retrieval.R, textual.R, corpus.R, evaluation.R, contracts.R, experiments.R, files.R):
    for name, query in part.queries.items():
        REGISTRY.query(name, part.oracles.get(name))(query)
