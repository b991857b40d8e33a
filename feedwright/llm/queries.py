"""Imports every operator module, which registers its query."""

from feedwright.llm import alignment, decontaminate, language_model, license_scan, multi_index, packing, quality_rules, sharding, simhash, suffix_dedup, url_filter, vantage, warc  # noqa: F401
from feedwright.llm.common import ORACLES, QUERIES  # noqa: F401
