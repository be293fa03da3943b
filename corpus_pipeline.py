"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, mixing.

The stages and their defined cases are in ``tidemark.llm.pipeline``.
"""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
