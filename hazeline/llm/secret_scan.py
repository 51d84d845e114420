"""Secrets in whole texts: an Aho-Corasick prefilter, regular expressions anchored at its hits, then checksums.

One automaton walks every text once and finds the keywords that a secret must begin with.  Regular expressions are
tried only at these places, never searched for.  Bare hexadecimal keys have no keyword: their prefilter is the shortest
accepted run, looked for in a copy of the text that tells only which bytes are such digits.  Formats that carry a checksum
count only if it is right.  Everything runs on UTF-8 bytes, and places become code points at the end.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazeline.llm.common import schema_with, with_columns

SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv", "age", "nsec")

# The public token formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_TERMS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "xprv": ("xprv",), "age": ("age-secret-key-1",),
    "nsec": ("nsec1",),
}
FORMS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]++"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(rf"xprv[{BASE58}]{{107}}(?![A-Za-z0-9])"),
    "age": re.compile(rf"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![A-Za-z0-9])"),
    "nsec": re.compile(rf"nsec1[{BECH32}]{{58}}(?![A-Za-z0-9])"),
}
HEX_RUN = re.compile(r"[0-9a-f]++")
HEX_LEAST = 24
HEX_DIGITS = bytes(104 if c in b"0123456789abcdef" else 46 for c in range(256))  # h for a digit, a dot for others


def crc_ends_it(token: str) -> bool:
    """The last six of the 36 characters are the CRC-32 of the others, in base 62."""
    value, tail = zlib.crc32(token[4:34].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        tail = BASE62[digit] + tail
    return token[34:] == tail


def base58_checked(key: str) -> bool:
    """The last four of the 82 bytes begin the double SHA-256 of the others."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    if value >= 1 << 656:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_checked(key: str) -> bool:
    """The six last characters close the polynomial over prefix and data."""
    prefix, data = key.lower().rsplit("1", 1)
    check = 1
    for value in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for i, term in enumerate(BECH32_TERMS):
            check ^= term if top >> i & 1 else 0
    return check == 1


HOLDS = {
    "assign": lambda m: len(m.group(1)) >= 6, "access": lambda m: len(m.group()) >= 20,
    "github": lambda m: crc_ends_it(m.group()), "npm": lambda m: crc_ends_it(m.group()),
    "xprv": lambda m: base58_checked(m.group()), "age": lambda m: bech32_checked(m.group()), "nsec": lambda m: bech32_checked(m.group()),
}


def prefilter() -> ahocorasick.Automaton:
    """All keywords in lower case, each with its kind and length."""
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def byte_spans(raw: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in bytes, by start and kind; leftmost and non-overlapping within each kind."""
    out: list[tuple[int, int, int]] = []
    view = None
    done = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in keywords.iter(raw.lower().decode("latin-1")))
    for at, kind in hits:
        if at < done[kind]:
            continue
        view = raw.decode("latin-1") if view is None else view
        m = FORMS[kind].match(view, at)
        if m is None:
            continue
        done[kind] = m.end()
        if HOLDS[kind](m):
            out.append((at, KINDS.index(kind), m.end()))
    digits, run = raw.translate(HEX_DIGITS), b"h" * HEX_LEAST
    at = digits.find(run)
    while at >= 0:
        view = raw.decode("latin-1") if view is None else view
        end = HEX_RUN.match(view, at).end()
        out.append((at, KINDS.index("hex"), end))
        at = digits.find(run, end)
    return sorted(out)


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def find(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds ``spans``: kind, start and end (code points, end exclusive) and whether its kind is a base one, by start and kind.

    Base kinds are ``assign``, ``access`` and ``hex``; the others are formats whose own checksum is right, and may lie
    inside a base span.  Null and empty texts have no spans.  A text is read once whatever its length; only the spans
    and, in a text that has some and is not ASCII, one count per byte are kept.  Other columns and repeated rows stay; a
    column named like ``spans`` is replaced; an empty table gives an empty one.  ``pii.mask`` takes the spans out.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def work(batches):
        keywords = prefilter()
        for batch in batches:
            rows = []
            for raw in batch.column(text).cast(pa.binary()):
                found = in_code_points(raw.as_py(), byte_spans(raw.as_py(), keywords)) if raw.is_valid else []
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < len(BASE)} for a, k, b in found])
            yield with_columns(batch, {spans: pa.array(rows, kind)})

    return df.mapInArrow(work, schema_with(df, f"`{spans}` {SPANS}"))
