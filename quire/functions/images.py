"""What pictures' bytes tell: the quality that a JPEG was saved with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard's quantization table for brightness, row by row.
BRIGHTNESS = [
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
]

#: The same in the order of files: along the anti-diagonals, to and fro.
ZIGZAG = [BRIGHTNESS[r][s - r] for s in range(15) for r in (range(s + 1) if s % 2 else range(s, -1, -1)) if r < 8 and s - r < 8]


def jpeg_quality_of(data: bytes | None) -> int | None:
    """Estimated quality from 1 to 100: how the first table for brightness relates to the standard's. Null for what isn't a JPEG or has no such table."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF):
            at += 1
            continue
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big") - 2
        segment, at = data[at + 4 : at + 4 + length], at + 4 + max(length, 0)
        if marker == 0xDB:
            k = 0
            while k < len(segment):
                table, wide = segment[k] & 15, segment[k] >> 4 != 0
                raw, k = segment[k + 1 : k + 1 + (128 if wide else 64)], k + 1 + (128 if wide else 64)
                values = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else [*raw]
                if table == 0 and len(values) == 64:
                    scale = sum(100.0 * v / s for v, s in zip(values, ZIGZAG, strict=True)) / 64
                    quality = 100.0 if set(values) == {1} else (200.0 - scale) / 2 if scale <= 100 else 5000.0 / scale
                    return int(quality + 0.5)
        if marker == 0xDA:
            return None
    return None


def jpeg_quality(data: Column) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: jpeg_quality_of(None if b is None else bytes(b))).astype("Int32")

    return run(data)
