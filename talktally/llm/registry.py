"""All registered queries of this subpackage."""

from talktally.llm import alignment, bpe, line_dedup, lm_scoring, minhash, mixing, nearest, quality_model, quality_rules, secret_scan, token_counts, toxicity, whitening  # noqa: F401 - registers on import
from talktally.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
