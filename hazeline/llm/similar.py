"""Links between similar items that share a band of their sketches, shared by the document and paragraph operators.

Within a band no all-pairs list is made.  Every band's most connected item is its leader; all others are verified
against the leader.  Components of these links settle nearly all bands.  Only where a band still holds items of
different components are the pairs across components verified too, so that no link between components is lost: as
pairs in bands of a few items, in blocks of items in larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, stored
from hazeline.llm.components import components

SMALL, MINORS, MEMBERS, COLUMNS = 16, 256, 512, 4096
CACHED = 32 << 20  # bytes of sets a task remembers

Sets = Callable[[list[str]], list[np.ndarray]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def verified(pairs: DataFrame, contents: DataFrame, sets: Callable[[], Sets], least: int) -> DataFrame:
    """Pairs whose full sets have ``100 * intersection >= least * union``.  ``sets`` makes the set builder in a task."""
    a = contents.select(F.col("id").alias("a"), F.col("content").alias("ca"))
    b = contents.select(F.col("id").alias("b"), F.col("content").alias("cb"))

    def work(batches):
        build, kept, held = sets(), {}, 0
        for batch in batches:
            for part in pieces(batch, "ca", 200):
                if held > CACHED:
                    kept, held = {}, 0
                sides = []
                for key, content in (("a", "ca"), ("b", "cb")):
                    own = [(k, xxhash.xxh128_digest((t or "").encode()), t or "") for k, t in zip(part.column(key).to_pylist(), part.column(content).to_pylist())]
                    new = list({(k, h): t for k, h, t in own if (k, h) not in kept}.items())
                    for (name, _), found in zip(new, build([t for _, t in new])):
                        kept[name] = found
                        held += found.nbytes
                    sides.append([kept[k, h] for k, h, _ in own])
                good = []
                for x, y in zip(*sides):
                    both = overlap(x, y)
                    good.append(100 * both >= least * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "ca", "cb").mapInArrow(work, "a bigint, b bigint")


def links(items: DataFrame, contents: DataFrame | Callable[[DataFrame], DataFrame], sets: Callable[[], Sets], least: int = 80,
          estimated: Callable[[DataFrame], DataFrame] | None = None, check: Callable[..., DataFrame] = verified) -> DataFrame:
    """All links ``(a, b)`` needed for the components of ``items (id, n, bands)``, verified on ``contents (id, content)``
    or on what ``contents`` makes of a table of ids.

    ``n`` is the set size: sizes too far apart rule a link out.  ``estimated`` may drop pairs by their sketches first;
    ``check`` verifies pairs on full sets, as ``verified`` does.  Ids are not null; several contents of one id
    count as one item that is linked when any of them is.
    """
    rows = items.select("id", "n", F.explode("bands").alias("key"))
    # Sizes are written before they are joined: Spark splits a hot key's partition of plain rows, not of an aggregate.
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    shared = stored(rows.join(sizes, "key"))
    ids = shared.select("id").distinct()
    near = stored(contents(ids) if callable(contents) else contents.join(ids, "id", "left_semi").dropDuplicates(["id", "content"]))
    reach = shared.groupBy("id").agg(F.sum("size").alias("reach"))
    leader = F.max(F.struct("reach", (-F.col("id")).alias("order"), F.col("id").alias("leader"), F.col("n").alias("n_leader")))
    leaders = shared.join(reach, "id").groupBy("key").agg(leader.alias("top")).select("key", "top.leader", "top.n_leader")

    def close(n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= least * F.greatest(n, m)

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        # Written between the two Python steps, so that a task never runs both at once.
        return check(stored(estimated(pairs)) if estimated else pairs, near, sets, least)

    led = shared.join(stored(leaders), "key").filter("id <> leader").filter(close(F.col("n"), F.col("n_leader")))
    first = stored(checked(led.select(F.col("id").alias("a"), F.col("leader").alias("b"))))
    at = stored(components(first))
    placed = shared.join(at, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = stored(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high"))
    open_ = stored(placed.join(mixed.select("key"), "key", "left_semi").select("key", "id", "n", "component"))
    few = stored(open_.groupBy("key").agg(F.count("*").alias("members")))
    small = open_.join(few.filter(F.col("members") <= SMALL).select("key"), "key", "left_semi")
    other = small.select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "component")])
    across = small.join(other, "key").filter("component < component_b").filter(close(F.col("n"), F.col("n_b")))
    across = checked(across.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")))
    large = open_.join(few.filter(F.col("members") > SMALL), "key")
    return first.unionByName(stored(across)).unionByName(stored(tiled(large, near, sets, least)))


def tiled(rows: DataFrame, contents: DataFrame, sets: Callable[[], Sets], least: int) -> DataFrame:
    """Links between components within large bands ``(key, id, component, members)``.

    The items outside a band's largest component meet all its items, in tiles of bounded blocks that hold contents.  A
    tile counts all intersections by one product of incidence matrices and emits links only.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("own"))
    top = sizes.groupBy("key").agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("all"))
    top = top.select("key", F.col("top.component").alias("main"), (F.col("all") - F.col("top.own")).alias("minors"))
    placed = stored(rows.join(top, "key").withColumn("across", F.ceil(F.col("minors") / MINORS).cast("int")).withColumn(
        "down", F.ceil(F.col("members") / MEMBERS).cast("int")))
    spot = F.xxhash64("id")
    minors = placed.filter("component <> main").select(
        "key", F.pmod(spot, "across").cast("int").alias("i"), F.explode(F.expr("sequence(0, down - 1)")).alias("j"), F.lit(True).alias("minor"), "id", "component")
    members = placed.select(
        "key", F.explode(F.expr("sequence(0, across - 1)")).alias("i"), F.pmod(spot, "down").cast("int").alias("j"), F.lit(False).alias("minor"), "id", "component")
    full = minors.unionByName(members).join(contents, "id")

    def tile(table: pa.Table) -> pa.Table:
        build, sides = sets(), []
        for flag in (True, False):
            side = table.filter(pa.compute.equal(table.column("minor"), flag))
            own = build([t or "" for t in side.column("content").to_pylist()])
            sides.append((side.column("id").to_numpy(), side.column("component").to_numpy(), own))
        (xi, xc, x), (yi, yc, y) = sides
        if not len(xi) or not len(yi):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
        both = np.zeros((len(x), len(y)), np.float64)
        places = [[(k, np.searchsorted(shared, s[np.isin(s, shared)])) for k, s in enumerate(side)] for side in (x, y)]
        for low in range(0, len(shared), COLUMNS):
            marks = [np.zeros((len(side), COLUMNS), np.float32) for side in (x, y)]
            for m, own in zip(marks, places):
                for k, at in own:
                    m[k, at[np.searchsorted(at, low) : np.searchsorted(at, low + COLUMNS)] - low] = 1
            both += marks[0] @ marks[1].T
        nx, ny = (np.array([len(s) for s in side]) for side in (x, y))
        r, c = np.nonzero((100 * both >= least * (nx[:, None] + ny - both)) & (xc[:, None] != yc) & (both > 0))
        return pa.table({"a": pa.array(np.minimum(xi[r], yi[c])), "b": pa.array(np.maximum(xi[r], yi[c]))})

    return full.groupBy("key", "i", "j").applyInArrow(tile, "a bigint, b bigint").distinct()
