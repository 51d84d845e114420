"""Spelling variants of one another, found through a variable-length gram index.

Words are counted over whole texts.  A dictionary keeps every shortest gram, and longer grams only where their beginning is
frequent among the distinct words.  Each word is cut into the longest dictionary grams at its places, without those that
lie inside another.  One edit can touch only so many of them, wherever it falls; the grams it leaves are the least that a
near word must share.  Inverted lists are joined on the rarest grams that this bound asks for, pairs that share fewer
grams than both bounds ask for go, and the others are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import sent, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, DICTIONARY, FREQUENT = 2, 50_000, 1000
HELD_WORDS = 400_000


def lost_letter(key: str) -> Callable[[str], str]:
    """Takes one code point out of a run if a checksum of key and run says so: a stand-in for typing errors."""
    begun = zlib.crc32(f"{key}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), begun)
        if h % 199:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return change


def word_counts(df: DataFrame, key: str, text: str, change: Callable[[str], Callable[[str], str]] | None = None) -> DataFrame:
    """``(word, n)`` over all texts: runs of letters with A-Z lowered, each first passed through ``change(key)(run)``.

    A null key is an empty one, a null text has no words.  Repeated rows count again, other columns play no part.  Counts
    are summed in the tasks before they are shuffled; a task holds ``HELD_WORDS`` words and those of one text.
    """
    def work(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                own = Counter(RUN.findall(t.encode().lower().decode()) if t else ())
                if change is None:
                    held.update(own)
                else:
                    told = change("" if k is None else k)
                    for run, n in own.items():
                        held[told(run)] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(work, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """Cuts words into variable grams of ``SHORTEST`` to ``longest`` code points by a dictionary of longer ones."""

    def __init__(self, longer: list[str], longest: int):
        self.longer, self.longest = frozenset(longer), longest
        self.heads = frozenset(g[:i] for g in longer for i in range(1, len(g)))
        self.tails = frozenset(g[-i:] for g in longer for i in range(1, len(g)))

    def cut(self, word: str) -> list[tuple[int, str]]:
        """``(place, gram)`` in order; at each place the longest dictionary gram, unless it lies inside an earlier one."""
        out, reach = [], 0
        for p in range(len(word) - SHORTEST + 1):
            size = next((q for q in range(min(self.longest, len(word) - p), SHORTEST, -1) if word[p : p + q] in self.longer), SHORTEST)
            if p + size > reach:
                out.append((p, word[p : p + size]))
                reach = p + size
        return out

    def affected(self, word: str, cut: list[tuple[int, str]]) -> int:
        """The most grams of the cut that any one edit can change.

        An edit takes out ``word[a:b]``: one code point, or none for an insertion.  Grams that meet the place are
        changed.  A gram left of it goes if a gram beginning no later could now grow over the place; one right of it
        goes if a gram ending no earlier could now begin before it.
        """
        most = first = 0
        for a in range(len(word) + 1):
            while first < len(cut) and cut[first][0] + 2 * self.longest < a:
                first += 1
            left = a
            for p in range(max(0, a - self.longest + 1), a):
                if word[p:a] in self.heads:
                    left = p
                    break
            for b in (a, a + 1):
                if b > len(word):
                    continue
                right = next((e for e in range(min(len(word), b + self.longest - 1), b, -1) if word[b:e] in self.tails), b)
                hit = 0
                for p, g in cut[first : first + 4 * self.longest]:
                    e = p + len(g)
                    hit += (p < b and e > a) or (e <= a and p >= left) or (p >= b and e <= right)
                most = max(most, hit)
        return most


def dictionary(words: DataFrame, longest: int) -> Grams:
    """Grams longer than the shortest whose beginnings are frequent: more than one in ``FREQUENT`` of all shortest grams
    begin alike.  At most ``DICTIONARY`` of them, the most frequent ones; any dictionary gives the same pairs."""
    def work(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                held.update(w[p : p + q] for q in range(SHORTEST, longest + 1) for p in range(len(w) - q + 1))
            if len(held) > HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"gram": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                held.clear()
        yield pa.RecordBatch.from_pydict({"gram": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    if longest == SHORTEST:
        return Grams([], longest)
    grams = stored(words.select("word").mapInArrow(work, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.filter(F.length("gram") == SHORTEST).agg(F.sum("n")).first()[0] or 0
    usual = grams.filter((F.length("gram") < longest) & (F.col("n") * FREQUENT > total)).select(F.col("gram").alias("head"))
    deeper = grams.filter(F.length("gram") > SHORTEST).withColumn("head", F.expr("left(gram, length(gram) - 1)"))
    kept = deeper.join(usual, "head", "left_semi").orderBy(F.desc("n"), "gram").limit(DICTIONARY)
    return Grams([r.gram for r in kept.select("gram").collect()], longest)


def postings(words: DataFrame, grams: Grams) -> DataFrame:
    """Per word: its length, gram places ``cut`` and the least number ``least`` of grams that a near word shares."""
    held = sent(words.sparkSession, grams)
    place = pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.string())]))

    def work(batches):
        own = held()
        for batch in batches:
            cuts, least = [], []
            for w in batch.column("word").to_pylist():
                cut = own.cut(w)
                cuts.append([{"place": p, "gram": g} for p, g in cut])
                least.append(len(cut) - own.affected(w, cut))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(cuts, place), pa.array(least, pa.int32())],
                                             ["word", "n", "cut", "least"])

    return words.mapInArrow(work, "word string, n bigint, cut array<struct<place:int,gram:string>>, least int")


def near_pairs(words: DataFrame, shortest_word: int) -> DataFrame:
    """``(a, b, n_a, n_b)``, each pair in one direction, of words that differ by exactly one inserted, deleted or replaced
    code point.  ``words (word, n)`` are distinct and have ``shortest_word`` code points at least.

    With grams of at most half the shortest word's length, no edit reaches both ends of a word, so every word
    keeps a gram of its own under any edit and no pair is missed.
    """
    if shortest_word < 2 * SHORTEST:
        raise ValueError(f"words of fewer than {2 * SHORTEST} code points may share no gram with a near word")
    cut = stored(postings(words, dictionary(words, min(3, shortest_word // 2))))
    every = cut.select("word", F.length("word").alias("size"), "cut", "least", F.explode("cut").alias("at"))
    every = every.select("word", "size", "least", F.size("cut").alias("grams"), "at.place", "at.gram")
    weight = every.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = F.sort_array(F.collect_list(F.struct("f", "gram", "place")))
    lists = every.join(stored(weight), "gram").groupBy("word", "size", "least", "grams").agg(ranked.alias("by"))
    rare = stored(lists.select("word", "size", "least", F.explode(F.expr("slice(by, 1, grams - least + 1)")).alias("at")).select(
        "word", "size", "least", "at.gram", "at.place"))
    # A gram keeps its distance from the start if the edit lies behind it, from the end if before it.
    shifted = F.when(F.col("place") > 0, F.array(F.col("place"), F.col("place") - 1)).otherwise(F.array("place"))
    longer = rare.select(F.col("word").alias("a"), (F.col("size") - 1).alias("size"), "gram", F.explode(shifted).alias("place"))
    same = rare.select(F.col("word").alias("a"), "size", "gram", "place")
    short = rare.withColumnRenamed("word", "b").drop("least")
    found = same.join(short, ["gram", "size", "place"]).filter("a < b").select("a", "b").union(
        longer.join(short, ["gram", "size", "place"]).select("a", "b")).distinct()
    sides = [cut.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"), F.col("cut").alias(f"cut_{c}"), F.col("least").alias(f"least_{c}")) for c in "ab"]
    pairs = found.join(sides[0], "a").join(sides[1], "b")
    moved = F.expr("filter(transform(cut_a, g -> named_struct('place', g.place - 1, 'gram', g.gram)), g -> g.place >= 0)")
    full = F.when(F.length("a") == F.length("b"), F.size(F.array_intersect("cut_a", "cut_b"))).otherwise(
        F.size(F.array_intersect(F.array_union("cut_a", moved), "cut_b")))
    pairs = pairs.filter(full >= F.greatest("least_a", "least_b"))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each word's chain of ``(word, form)``, by doubling the step until all stand still."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        at = stored(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, shortest_word: int = 6, times: int = 5) -> DataFrame:
    """One row per word of ``words (word, n)``: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word with the largest n, of equal ones the first in code-point order, if its n is at least
    ``times`` the word's, else null; ``form_n`` its n.  ``root`` ends the chain of forms, the word itself without a form.
    ``n_near`` counts near words.  Words are distinct and not null, n is positive and ``times`` at least 2, so that
    chains cannot close.  An empty table gives an empty one.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = stored(words.select("word", "n"))
    pairs = stored(near_pairs(words, shortest_word))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), "other", "m")).alias("top"))
    good = F.col("top.m") >= times * F.col("n")
    out = stored(words.join(best, "word", "left").select(
        "word", F.when(good, F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(good, F.col("top.m")).alias("form_n")))
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
