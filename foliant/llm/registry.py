"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op10_packing import op10_packing
from . import op5_paragraphs as paragraphs
from . import op7_ngram_join as ngram
from . import op8_warc as warc
from . import op9_mixing as mixing
from . import op11_audit as audit
from . import op12_chat as chat
from .op1_quality import op1_quality
from .op4_pseudonyms import op4_pseudonyms
from .op6_langid import op6_langid
from .op2_fingerprints import op2_fingerprints
from .op3_tokens import op3_tokens
from .op13_repair import op13_repair


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_fingerprints, op3_tokens, op4_pseudonyms, paragraphs.op5_paragraphs, op6_langid, ngram.op7_ngram_join, warc.op8_warc, mixing.op9_mixing, op10_packing, audit.op11_audit, chat.op12_chat, op13_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op5_paragraphs": paragraphs.SQL, "op7_ngram_join": ngram.SQL, "op8_warc": warc.SQL, "op9_mixing": mixing.SQL, "op11_audit": audit.SQL, "op12_chat": chat.SQL}
