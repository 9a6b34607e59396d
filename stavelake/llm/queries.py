"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .language import op7_language
from .licenses import op10_licenses
from .packing import op1_packing
from .quality import OP4_SQL, op4_quality
from .secrets import op8_secrets
from .simhash import op9_simhash
from .spelling import op13_spelling
from .substrings import OP12_SQL, op12_substrings
from .topk import OP2_SQL, op2_top_k
from .url_filter import OP3_SQL, op3_url_filter
from .warc import OP6_SQL, op6_warc
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_top_k": op2_top_k,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_substrings": op12_substrings,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op2_top_k": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_quality": OP4_SQL, "op6_warc": OP6_SQL, "op12_substrings": OP12_SQL}
