"""The corpus pipeline: STAGES over documents, and run() that applies them all."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
