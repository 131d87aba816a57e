"""The training-data pipeline; its stages are in finlattice.llm.stages."""

from finlattice.llm.stages import STAGES, run

#: Learned scores, hashes and subword ids have no SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
