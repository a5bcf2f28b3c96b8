"""Every query of this subpackage; importing it fills the registry."""

from rolecall.llm import (  # noqa: F401
    filter_audit,
    fingerprints,
    line_dedup,
    mixing,
    near_dups,
    packing,
    passages,
    periodic_runs,
    sharding,
    token_counts,
    token_files,
    top_k,
    toxicity,
)
from rolecall.llm.registry import ORACLES, QUERIES  # noqa: F401
