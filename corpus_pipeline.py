"""The corpus pipeline over ``documents``; its stages are in textloom.llm.pipeline."""

from textloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
