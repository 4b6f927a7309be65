"""The stages that clean a corpus, and the run of all of them: see ``cohortspark.llm.pipeline``."""

from cohortspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
