"""The corpus pipeline, whose stages live in the subpackage of the training-data operators."""

from threadloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
