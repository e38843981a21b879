"""Queries of the training-data operators and the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from functools import wraps

from .bpe import byte_bpe
from .common import prepare
from .exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from .filter_audit import FILTER_AUDIT_SQL, filter_audit
from .html_text import html_main_text
from .mixing import mixing_weights
from .packing import min_slack_packing
from .pii import pii_weak_supervision
from .quality import quality_classifier
from .simhash import simhash_near_dedup
from .spotsigs import spotsigs_fingerprints
from .url_filter import URL_FILTER_SQL, url_filter
from .vector_codes import vector_codes
from .warc import WARC_SQL, warc_revisits


def _prepared(query):
    @wraps(query)
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_exact_dedup": exact_dedup,
    "op2_pii_weak_supervision": pii_weak_supervision,
    "op3_warc_revisits": warc_revisits,
    "op4_mixing_weights": mixing_weights,
    "op5_html_main_text": html_main_text,
    "op6_min_slack_packing": min_slack_packing,
    "op7_spotsigs_fingerprints": spotsigs_fingerprints,
    "op8_simhash_near_dedup": simhash_near_dedup,
    "op9_quality_classifier": quality_classifier,
    "op10_url_filter": url_filter,
    "op11_filter_audit": filter_audit,
    "op12_byte_bpe": byte_bpe,
    "op13_vector_codes": vector_codes,
}
QUERIES = {name: _prepared(query) for name, query in QUERIES.items()}

ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP_SQL,
    "op3_warc_revisits": WARC_SQL,
    "op10_url_filter": URL_FILTER_SQL,
    "op11_filter_audit": FILTER_AUDIT_SQL,
}
