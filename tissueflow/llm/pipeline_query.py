"""The pipeline as a registered query."""

from __future__ import annotations

import corpus_pipeline

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
