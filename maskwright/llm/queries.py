"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from functools import wraps

from maskwright.llm import bpe, decontaminate, fingerprint, html, paragraphs, secrets, simhash, toxicity, urls, warc
from maskwright.llm.common import ship


def _shipped(query):
    """The query, once the executors have this package."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    q.__name__: _shipped(q)
    for q in (
        warc.op1_warc,
        urls.op2_urls,
        decontaminate.op3_decontaminate,
        bpe.op4_bpe,
        secrets.op5_secrets,
        fingerprint.op6_fingerprint,
        paragraphs.op7_paragraphs,
        simhash.op8_simhash,
        toxicity.op9_toxicity,
        html.op10_html,
    )
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
}
