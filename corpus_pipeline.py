"""Corpus pipeline: from raw documents to token ids, in five stages; its code is in ``casegrain.llm.pipeline``."""

from casegrain.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
