"""Recursive decoding of encoded values (base64, URL base64, hexadecimal, percent)."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DECODED = "array<struct<value: string, encoding: string, depth: int>>"


def _printable(data: bytes) -> str | None:
    text = data.decode("utf-8", "replace")
    ok = all(c in "\n\r\t " or unicodedata.category(c)[0] in "LMNPS" for c in text)
    return text if ok else None


def _base64(s: str, alphabet: str) -> str | None:
    compact = re.sub("[\r\n]", "", s)
    if not re.fullmatch(rf"(?:[A-Za-z0-9{alphabet}]{{4}})*(?:[A-Za-z0-9{alphabet}]{{2}}==|[A-Za-z0-9{alphabet}]{{3}}=)?", compact):
        return None
    return _printable(base64.b64decode(compact, altchars=b"-_" if "_" in alphabet else None))


def _steps(s: str):
    """Encoding and value of each way in which s can be read as encoded."""
    if len(s.encode()) >= 16:
        yield "base64", _base64(s, "+/")
        yield "base64url", _base64(s, r"_\-")
    if len(s) >= 32 and re.fullmatch("(?:[0-9A-Fa-f]{2})+", s):
        yield "hex", _printable(binascii.unhexlify(s))
    if "%" in s and re.fullmatch(r"(?:[^%]|%[0-9A-Fa-f]{2})*", s, re.S):
        value = unquote_to_bytes(s.replace("+", " ")).decode("utf-8", "replace")
        yield "percent", value if value != s else None


def decode_value(s: str, max_depth: int) -> list[tuple[str, str, int]]:
    """Decoded values in depth-first order; a value is taken apart once."""
    out: list[tuple[str, str, int]] = []
    seen: set[str] = set()

    def visit(value: str, depth: int) -> None:
        if depth > max_depth or value in seen:
            return
        seen.add(value)
        for encoding, found in _steps(value):
            if found is not None and not (encoding == "base64url" and found in seen):
                out.append((found, encoding, depth))
                visit(found, depth + 1)

    visit(s, 1)
    return out


def decode_all(max_depth: int) -> Callable[[Column], Column]:
    """A vectorised function: string -> array of decoded values. Used on secrets of findings only."""

    @F.pandas_udf(DECODED)
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda s: [{"value": v, "encoding": e, "depth": d} for v, e, d in decode_value(s or "", max_depth)])

    return decode


def decode_tags(decoded: Column) -> Column:
    """``decoded:<encoding>`` of each value, and ``decode-depth:<n>`` where it lay deeper than one."""
    return F.flatten(
        F.transform(
            decoded,
            lambda d: F.when(
                d.depth > 1, F.array(F.concat(F.lit("decoded:"), d.encoding), F.concat(F.lit("decode-depth:"), d.depth.cast("string")))
            ).otherwise(F.array(F.concat(F.lit("decoded:"), d.encoding))),
        )
    )
