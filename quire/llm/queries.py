"""Queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .chat import op1_chat
from .licenses import op5_licenses
from .media import op10_media
from .minhash import op4_minhash
from .mixing import OP8_SQL, op8_mixing
from .quality import op2_quality
from .repeats import op7_repeats
from .token_files import op6_token_files
from .warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_licenses": op5_licenses,
    "op6_token_files": op6_token_files,
    "op7_repeats": op7_repeats,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_media": op10_media,
}

SQL: dict[str, str] = {"op8_mixing": OP8_SQL, "op9_warc": OP9_SQL}
