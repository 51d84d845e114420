"""Personal data in whole texts: fixed base patterns, and spans that a trained character tagger adds.

The tagger is a bidirectional LSTM with CRF transitions over overlapping windows.  Scores of windows that overlap are
blended with weights falling towards the window edges, and one best path is taken over the whole joined stretch.  A
span the tagger proposes counts only if it keeps its kind's own rules and meets no base span.  As every rule asks for
an @ or for digits, stretches farther than a window from any of these hold no span and are not run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, schema_with, sent, texts, thinned, with_columns
from hazeline.llm.tagger import Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a match cannot start inside one, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NATIONAL = re.compile(r"[+(]?[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WINDOW, STRIDE, PAD = 96, 48, 132
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def luhn(digits: str) -> bool:
    twice = str.maketrans("0123456789", "0246813579")
    return sum(map(int, digits[-1::-2] + digits[-2::-2].translate(twice))) % 10 == 0


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(s: str) -> bool:
    return 10 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds, leftmost and non-overlapping within each kind, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    if DIGITS.search(text):
        for kind, pattern, holds in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(m.group())]
    return sorted(out)


def keeps_rules(kind: int, s: str) -> bool:
    """What a span proposed by the tagger must fulfil."""
    if kind == 0:
        return EMAIL.fullmatch(s) is not None
    if kind == 1:
        return IP.fullmatch(s) is not None and is_ip(s)
    if kind == 2:
        return CARD.fullmatch(s) is not None and is_card(s)
    return NATIONAL.fullmatch(s) is not None and is_phone(s) and sum(c in " ().-+" for c in s) >= 2


def stretches(text: str, reach: int = STRIDE) -> list[tuple[int, int]]:
    """Merged surroundings of all trigger characters."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.start() + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blended(model: Tagger, parts: list[str], most: int = 512) -> list[np.ndarray]:
    """Scores of each part: those of its overlapping windows, weighted by the distance from the window's edge."""
    ids, owner, starts = [], [], []
    for k, part in enumerate(parts):
        own = char_ids(part)
        for a in range(0, max(1, len(own) - STRIDE), STRIDE):
            piece = np.full(WINDOW, PAD)
            piece[: len(own[a : a + WINDOW])] = own[a : a + WINDOW]
            ids.append(piece), owner.append(k), starts.append(a)
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)
    sums = [np.zeros((len(p), model.tags)) for p in parts]
    totals = [np.zeros((len(p), 1)) for p in parts]
    for i in range(0, len(ids), most):
        scores = model.run(np.stack(ids[i : i + most]))
        for s, k, a in zip(scores, owner[i : i + most], starts[i : i + most]):
            n = min(WINDOW, len(parts[k]) - a)
            sums[k][a : a + n] += s[:n] * weight[:n]
            totals[k][a : a + n] += weight[:n]
    return [s / t for s, t in zip(sums, totals)]


def proposals(model: Tagger, rows: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger adds to each text."""
    where = [(i, a, b) for i, t in enumerate(rows) for a, b in stretches(t)]
    where.sort(key=lambda x: x[2] - x[1])
    added: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    i = 0
    while i < len(where):
        size, j = 0, i
        while j < len(where) and (j == i or (j - i + 1) * (where[j][2] - where[j][1]) <= 100_000):
            j += 1
        group, i = where[i:j], j
        parts = [rows[k][a:b] for k, a, b in group]
        scores = blended(model, parts)
        lengths = np.array([len(p) for p in parts])
        padded = np.zeros((len(parts), int(lengths.max()), model.tags))
        for k, s in enumerate(scores):
            padded[k, : len(s)] = s
        for (k, a, _), tags in zip(group, model.best_paths(padded, lengths)):
            begins = np.flatnonzero(tags % 2 == 1)
            for p in begins.tolist():
                kind, end = int(tags[p]) // 2, p + 1
                while end < len(tags) and tags[end] == tags[p] + 1:
                    end += 1
                start, end = a + p, a + end
                if keeps_rules(kind, rows[k][start:end]) and all(e <= start or end <= s for s, _, e in base[k]):
                    added[k].append((start, kind, end))
    return added


def find(df: DataFrame, model: Tagger, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds ``spans``: kind, start and end (code points, end exclusive) and whether it is a base span, by start and kind.

    Null and empty texts have no spans.  Spans of the tagger never meet base spans.  Other columns and repeated rows
    stay; a column named like ``spans`` is replaced.
    """
    held = sent(df.sparkSession, model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def work(batches):
        own = held()
        for batch in (p for b in batches for p in pieces(b, text)):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in x] for x in all_spans(own, texts(batch.column(text)))]
            yield with_columns(batch, {spans: pa.array(found, kind)})

    return df.mapInArrow(work, schema_with(df, f"`{spans}` {SPANS}"))


def all_spans(model: Tagger, rows: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """``(start, kind number, end, base)`` of base spans and those the tagger adds, by start and kind."""
    base = [base_spans(t) for t in rows]
    more = proposals(model, rows, base)
    return [sorted([(*s, True) for s in x] + [(*s, False) for s in y], key=lambda s: s[:2]) for x, y in zip(base, more)]


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span, joined where they meet, replaced by its first kind's name in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replaces the spans in the text; ``spans`` is dropped.  Null texts and rows without spans stay as they are."""
    def work(batches):
        for batch in (p for b in batches for p in pieces(b, text)):
            found = [[(s["start"], s["end"], s["kind"]) for s in x or []] for x in batch.column(spans).to_pylist()]
            clean = [masked(t, x) for t, x in zip(batch.column(text).to_pylist(), found)]
            kept = batch.drop_columns([spans])
            yield kept.set_column(kept.schema.get_field_index(text), text, pa.array(clean, pa.string()))

    return df.mapInArrow(work, df.drop(spans).schema)


def redacted(df: DataFrame, model: Tagger, text: str = "text") -> DataFrame:
    """``find`` and ``mask`` in one step, so that a text is sent to Python once.  Null texts stay null."""
    held = sent(df.sparkSession, model)

    def work(batches):
        own = held()
        for batch in (p for b in batches for p in pieces(b, text)):
            rows = batch.column(text).to_pylist()
            found = all_spans(own, [t or "" for t in rows])
            clean = [masked(t, [(a, b, KINDS[k]) for a, k, b, _ in x]) for t, x in zip(rows, found)]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(clean, pa.string()))

    return df.mapInArrow(work, df.schema)


def made_up(rng: np.random.Generator, kind: int) -> str:
    """A value of the kind; formats vary."""
    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def word(n):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    pick = int(rng.integers(0, 4))
    if kind == 0:
        return word(rng.integers(3, 10)) + ["", ".", "_", "-"][pick] + [word(4), digits(2)][pick % 2] + "@" + word(rng.integers(4, 9)) + [".com", ".org", ".example.net", ".co.uk"][pick]
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        head = str(rng.integers(3, 7)) + digits(14)
        number = next(head + c for c in "0123456789" if luhn(head + c))
        return number if pick < 2 else [" ", "-"][pick % 2].join(number[i : i + 4] for i in (0, 4, 8, 12))
    area, mid, last = digits(3), digits(3), digits(4)
    return [f"+1 ({area}) {mid}-{last}", f"+{digits(2)} {area} {mid} {last}", f"({area}) {mid}-{last}", f"+1-{area}-{mid}-{last}"][pick]


def training_windows(snippets: list[str], count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``count`` windows with tags: half are snippets with their base spans as labels, the others have values of all
    kinds set among words and numbers of snippets, often side by side."""
    rng = np.random.default_rng(seed)
    carriers = [re.sub(r"\S*[0-9@]\S*", "", s) for s in snippets if s] or ["the of and to in is"]
    marked = [s for s in snippets if base_spans(s)]
    ids, gold = np.full((count, WINDOW), PAD), np.zeros((count, WINDOW), np.int64)
    for row in range(count):
        spans: list[tuple[int, int, int]] = []
        if marked and row % 2:
            text = marked[int(rng.integers(len(marked)))]
            a = int(rng.integers(0, max(1, len(text) - WINDOW)))
            spans = [(s - a, k, e - a) for s, k, e in base_spans(text)]
            text = text[a : a + WINDOW]
        else:
            words = carriers[int(rng.integers(len(carriers)))].split() or ["a"]
            text = " ".join(words[: int(rng.integers(0, 6))])
            for kind in rng.permutation(4)[: int(rng.integers(1, 4))].tolist():
                text += " " if text else ""
                value = made_up(rng, kind)
                spans.append((len(text), kind, len(text) + len(value)))
                text += value + ("." if rng.random() < 0.1 else "")
                if rng.random() < 0.4:
                    text += " " + " ".join(words[-int(rng.integers(1, 4)) :])
                if rng.random() < 0.2:
                    text += " " + "".join(map(str, rng.integers(0, 10, int(rng.integers(1, 9)))))
        ids[row, : len(text[:WINDOW])] = char_ids(text[:WINDOW])
        for s, k, e in spans:
            if e > 0 and s < WINDOW:
                gold[row, max(s, 0) : min(e, WINDOW)] = 2 * k + 2
                gold[row, max(s, 0)] = 2 * k + 1
    return ids, gold


def snippets_of(df: DataFrame, text: str = "text", most: int = 400) -> list[str]:
    """Surroundings of the first @ or of the first four digits in a row, of at most ``most`` texts by hash order, looked
    for in some 200 times as many texts."""
    t = F.col(text)
    df = thinned(df, F.xxhash64(F.lit("snippets"), t), 200 * most, df.count())

    def around(at: Column) -> Column:
        return F.when(at > 0, F.substring(t, F.greatest(at - 70, F.lit(1)), F.lit(190)))

    found = df.select(t.alias(text)).filter(t.rlike("@|[0-9]{4}")).select(
        around(F.when(t.contains("@"), F.instr(t, "@")).otherwise(F.regexp_instr(t, F.lit("[0-9]{4}")))).alias("s"))
    return [r.s for r in found.orderBy(F.xxhash64("s"), "s").limit(most).collect()]


def train(df: DataFrame, text: str = "text", most: int = 400, windows: int = 1500, steps: int = 180) -> Tagger:
    """A tagger fitted on the driver from ``windows`` labelled windows around at most ``most`` snippets of the corpus."""
    model = Tagger(len(KINDS))
    model.fit(*training_windows(snippets_of(df, text, most), windows), steps)
    return model
