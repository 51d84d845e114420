"""Keys and labels: zone codes, accent folding, header names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _plain_letters() -> dict[str, str]:
    """Every letter up to the Latin extensions that decomposes canonically into one plain letter and marks."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.combining(m) for m in marks):
            out[c] = base
    return out


PLAIN_LETTERS = _plain_letters()


def zone_code(c: Column | str, width: int | None = 6) -> Column:
    """Canonical zone key: the code as text, cut to ``width`` characters (drops a trailing check digit)."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return text if width is None else F.substring(text, 1, width)


def fold_accents(c: Column | str) -> Column:
    """Letters without their accents, whether these are part of the letter or marks of their own behind it.  Letters that are
    not made of a plain one and marks, such as o with stroke, stay."""
    plain = F.translate(F.col(c) if isinstance(c, str) else c, "".join(PLAIN_LETTERS), "".join(PLAIN_LETTERS.values()))
    return F.regexp_replace(plain, "\\p{Mn}+", "")


def name_key(c: Column | str) -> Column:
    """Join key for free-text names: accents folded, upper case."""
    return F.upper(fold_accents(c))


def leading_number(c: Column | str) -> Column:
    """First run of digits as an integer, NULL when there is none."""
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(\d+)", 1).try_cast("int")


def clean_name(name: str) -> str:
    """Header text to snake case: accents folded, other signs to ``_``, ``x`` before a leading digit."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain).lower()
    snake = re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or "x"
    return f"x{snake}" if snake[0].isdigit() else snake


def clean_names(df: DataFrame) -> DataFrame:
    """All headers through :func:`clean_name`; repeats get ``_2``, ``_3`` ..."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = clean_name(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
