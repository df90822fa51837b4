"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from lineamix.llm.decontamination import decontamination
from lineamix.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from lineamix.llm.manifest import DATASET_MANIFEST_SQL, dataset_manifest
from lineamix.llm.near_dedup import NEAR_DEDUP_SQL, near_dedup
from lineamix.llm.packing import packing
from lineamix.llm.quality import quality_classifier
from lineamix.llm.secret_scan import secret_scan
from lineamix.llm.token_alignment import token_alignment
from lineamix.llm.token_counts import token_counts
from lineamix.llm.token_files import token_files
from lineamix.llm.toxicity import toxicity
from lineamix.llm.url_filter import URL_FILTER_SQL, url_filter
from lineamix.llm.warc_audit import WARC_AUDIT_SQL, warc_audit

QUERIES = {
    "op1_decontamination": decontamination,
    "op2_token_files": token_files,
    "op3_url_filter": url_filter,
    "op4_token_counts": token_counts,
    "op5_packing": packing,
    "op6_exact_dedup": exact_dedup,
    "op7_toxicity": toxicity,
    "op8_quality": quality_classifier,
    "op9_warc_audit": warc_audit,
    "op10_near_dedup": near_dedup,
    "op11_token_alignment": token_alignment,
    "op12_secret_scan": secret_scan,
    "op13_dataset_manifest": dataset_manifest,
}

ORACLE = {
    "op3_url_filter": URL_FILTER_SQL,
    "op6_exact_dedup": EXACT_DEDUP_SQL,
    "op9_warc_audit": WARC_AUDIT_SQL,
    "op10_near_dedup": NEAR_DEDUP_SQL,
    "op13_dataset_manifest": DATASET_MANIFEST_SQL,
}
