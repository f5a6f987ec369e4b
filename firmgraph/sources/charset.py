"""Bytes of a page as text, when the declared character set may be wrong."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names under which pages declare character sets.
ALIASES = {"utf8": "utf-8", "shift-jis": "shift_jis", "shiftjis": "shift_jis", "sjis": "shift_jis", "x-sjis": "shift_jis", "ms-kanji": "shift_jis", "windows-31j": "cp932", "cp-932": "cp932", "eucjp": "euc-jp", "x-euc-jp": "euc-jp"}
#: What letters of a range add to the plausibility of a Japanese text.
WEIGHTS = ((0xFFFD, 0xFFFD, -20.0), (0x3040, 0x30FF, 3.0), (0x4E00, 0x9FFF, 1.0), (0xFF61, 0xFF9F, -3.0), (0xE000, 0xF8FF, -10.0), (0x00, 0x7F, 0.1))


def declared(content_type: str | None, data: bytes) -> str | None:
    found = re.search(r"charset=([\w-]+)", content_type or "", re.I) or re.search(r"charset=[\"']?([\w-]+)", data[:4096].decode("latin-1"), re.I)
    name = found[1].lower().replace("_", "-") if found else None
    return ALIASES.get(name, name)


def plausibility(text: str) -> float:
    return sum(next((w for a, b, w in WEIGHTS if a <= ord(c) <= b), 0.0) for c in text[:4000])


def decode(data: bytes, content_type: str | None) -> tuple[str, str]:
    """Text and character set: UTF-8 if the bytes are, else the candidate whose text is most plausible, the declared first."""
    said = declared(content_type, data)
    if all(b < 0x80 for b in data):
        return data.decode("ascii"), said or "utf-8"
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    best = None
    for name in dict.fromkeys(n for n in (said, "cp932", "euc-jp", "utf-8") if n):
        try:
            codecs.lookup(name)
        except LookupError:
            continue
        text = data.decode(name, "replace")
        if best is None or plausibility(text) > best[0]:
            best = plausibility(text), text, name
    return best[1], best[2]


def decoded(pages: DataFrame, data: str = "body", content_type: str = "content_type") -> DataFrame:
    """pages with decoded(text, charset)."""

    @F.pandas_udf("text string, charset string")
    def read(bodies: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else decode(bytes(b), k) for b, k in zip(bodies, kinds)], columns=["text", "charset"])

    return pages.withColumn("decoded", read(data, content_type))
