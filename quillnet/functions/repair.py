"""Text that was UTF-8 and was read as Latin-1 or Windows-1252."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bytes_of_characters() -> dict[str, int]:
    """The byte behind each character of both code pages; bytes that Windows-1252 leaves open stand for themselves."""
    found = {chr(b): b for b in range(128, 256)}
    for b in range(128, 160):
        try:
            found[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return found


_BYTE = _bytes_of_characters()


def _signs(low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in _BYTE.items() if low <= b <= high) + "]"


#: UTF-8 as an automaton over such characters: a lead and as many continuations as it asks for. Of leads of two, those of Latin letters and
#: signs, Greek, Cyrillic, Hebrew and Arabic: what the others lead to is rarer than a capital before a closing quote, such as É».
_NEXT = _signs(0x80, 0xBF)
_LEAD = "(?:" + "|".join(_signs(a, b) for a, b in ((0xC2, 0xC5), (0xCE, 0xD1), (0xD7, 0xDB))) + ")"
_SEQUENCE = re.compile(f"{_LEAD}{_NEXT}|{_signs(0xE0, 0xEF)}{_NEXT}{{2}}|{_signs(0xF0, 0xF4)}{_NEXT}{{3}}")
_WIDE = re.compile(r"[^\x00-\x7F]")


def _line(line: str) -> str:
    """The line as it was, if every sign beyond ASCII in it is part of a UTF-8 sequence; read wrongly more than once, it is read again."""
    for _ in range(4):
        if not _WIDE.search(line) or _WIDE.search(_SEQUENCE.sub("", line)):
            break
        try:
            line = _SEQUENCE.sub(lambda m: bytes(_BYTE[c] for c in m[0]).decode(), line)
        except UnicodeDecodeError:
            break
    return line


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", "\n".join(map(_line, t.split("\n")))))


def repaired(text: Column) -> Column:
    """Each line read rightly again, and characters composed (NFC). Lines that hold other signs beyond ASCII are taken for right."""
    return _repaired(text)
