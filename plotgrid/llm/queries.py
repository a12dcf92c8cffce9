"""All queries of this subpackage."""

from plotgrid.llm import bpe, centroids, chat, decontamination, language, line_dedup, order_minhash, periodic_runs, quality, simhash, token_files, toxicity, url_filter  # noqa: F401  (register their queries)
from plotgrid.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
