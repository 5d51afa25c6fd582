"""The corpus pipeline. Its stages are in docspark.llm.pipeline."""

from docspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
