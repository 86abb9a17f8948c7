"""The training-data pipeline: its stages, its SQL and run(); see lodestar/llm/pipeline.py."""

from lodestar.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
