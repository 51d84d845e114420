"""The operators with production parameters over whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import bpe, lexical, mixing, neardup, neighbours, pages, paragraphs, pii, quality, secret_scan, sketch, spelling, toxicity
from hazeline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@functools.cache
def vocabulary(path: str) -> bpe.Vocabulary:
    return bpe.Vocabulary(bpe.read_ranks(path), public_tokenizers.PATTERN)


@query
def op1_bpe_tokens(spark, d):
    """Encodes every text and decodes the ids again."""
    known = vocabulary(public_tokenizers.path(RANKS))
    ids = bpe.encode(table(spark, d, "documents").select("doc_id", "text"), known).drop("text")
    ids = ids.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    out = bpe.decode(ids, known)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_hyperminhash(spark, d):
    """Classes of near-duplicate documents: two-word shingles, Jaccard 0.8 or more."""
    return neardup.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), width=2, least=80)


@query
def op9_paragraph_dedup(spark, d):
    """Paragraphs that repeat across documents: five-word shingles, Jaccard 0.8 or more; equal runs at every place."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return paragraphs.repeated_passages(docs, width=5, least=80).unionByName(paragraphs.repeated_runs(docs))


@query
def op10_bottom_k(spark, d, k=128):
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = sketch.with_next(docs.withColumn("own", sketch.sketch(F.col("text"), k)), "doc_id", ["text", "own"])
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"),
                      F.expr("substring(next_text, 1, cast(n_chars div 4 as int))"))
    docs = docs.withColumn("edited", edited).withColumn("new", sketch.sketch(F.col("edited"), k))

    def shown(c):
        return F.array_join(F.transform(c, lambda h: F.hex(h)), ",")

    return docs.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), shown("own").alias("fingerprint"),
        shown("new").alias("edited_fingerprint"), sketch.resemblance(F.col("own"), F.col("new"), k).alias("near_edited"),
        sketch.resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"), sketch.distinct_count(F.col("own"), k).alias("n_shingles"),
        sketch.containment(F.col("own"), F.col("new"), k).alias("contained"))


def span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and the list of all spans of each document."""
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op2_pii_tagger(spark, d):
    """Personal data in every text: base patterns, and spans of the trained tagger."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).drop("text")
    return span_digests(found, pii.KINDS)


@query
def op5_toxicity_cnn(spark, d):
    """Toxicity of every text, learnt from labels outside the held-out fifth."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scores = toxicity.scored(docs, toxicity.train(docs, table(spark, d, "labels").filter(~out)))
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_page_text(spark, d):
    """Main text of every page."""
    every = table(spark, d, "pages").select("page_id", "url", "html")
    out = pages.extracted(every, pages.train(every)).drop("html")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op4_quality_cotraining(spark, d):
    """Quality of every document, learnt from labels outside a held-out fifth."""
    docs, labels = (table(spark, d, n) for n in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.train(docs, labels.filter(~out))
    scores = quality.scored(docs.select("doc_id", "text", "lang", "source"), model)
    return scores.select("doc_id", out.alias("held_out"), "score_content", "score_meta", "score", (F.col("score") >= 0.5).alias("kept"))


@query
def op6_block_neighbours(spark, d):
    """The five nearest vectors of every fiftieth vector."""
    every = table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(every.filter("vec_id % 50 = 0"), every, k=5)


@query
def op11_spelling_variants(spark, d):
    """Words of six letters or more that occur five times or more, and the frequent word each may be a variant of."""
    words = spelling.word_counts(table(spark, d, "documents"), "doc_id", "text", spelling.lost_letter)
    return spelling.variants(words.filter((F.length("word") >= 6) & (F.col("n") >= 5)), shortest_word=6, times=5)


@query
def op12_secret_scan(spark, d):
    """Secrets in every text: base patterns behind keywords, and formats whose checksum is right."""
    found = secret_scan.find(table(spark, d, "documents").select("doc_id", "text")).drop("text")
    return span_digests(found, secret_scan.BASE)


@query
def op13_lexical_ranking(spark, d):
    """The ten highest-scoring documents of every benchmark item."""
    return lexical.ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


TREE = ["domain", "lang", "source"]
WEIGHTS = [{"web": 3, "print": 1}, {"en": 4, "de": 2, "fr": 2}, {}]


def with_domain(docs: DataFrame) -> DataFrame:
    """Documents with the root level of the mixing tree, told from the source's last digit, and their word counts."""
    domain = F.when(F.substring("source", -1, 1).isin(*"01234"), "web").otherwise("print")
    return docs.withColumn("domain", domain).withColumn("tokens", F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"))


@query
def op7_source_mixing(spark, d):
    """Half of all words, divided over domains, languages and sources; up to two epochs of a source."""
    docs = with_domain(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).drop("text")
    return mixing.mixed(docs, TREE, WEIGHTS, "tokens", "doc_id", share=0.5, epochs=2)


def divided_sql(level: int) -> str:
    """One level of the tree: the parents' budgets poured over siblings, as window sums."""
    path = TREE[: level + 1]
    up, own = ", ".join(["one", *path[:-1]]), ", ".join(["one", *path])
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in WEIGHTS[level].items())
    weight = f"CASE {path[-1]} {cases} ELSE 1.0 END" if cases else "1.0"
    return f"""
    n{level} AS (SELECT {own}, sum(capacity)::DOUBLE AS cap, ({weight})::DOUBLE AS weight FROM leaves GROUP BY {own}),
    m{level} AS (SELECT n.*, budget, cap / weight AS fill, (budget - coalesce(sum(cap) OVER (PARTITION BY {', '.join('n.' + c for c in up.split(', '))} ORDER BY cap / weight, {path[-1]}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY {', '.join('n.' + c for c in up.split(', '))} ORDER BY cap / weight, {path[-1]}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{level} n JOIN g{level - 1} g USING ({up})),
    g{level} AS (SELECT {own}, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS budget
        FROM (SELECT *, max(CASE WHEN fill > level THEN level END) OVER (PARTITION BY {up}) AS water FROM m{level})),"""


#: CRC-32 of a list of bytes, eight shifts a byte.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, {}), lambda s, b: list_reduce([xor(s, b), 1, 1, 1, 1, 1, 1, 1, 1],
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLE: dict[str, str] = {
    "op11_spelling_variants": f"""
    WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-zÀ-ÿ]+') AS runs FROM documents),
    r AS (SELECT coalesce(k, '') AS k, run, count(*) AS n FROM (SELECT k, unnest(runs) AS run FROM d) GROUP BY k, run),
    b AS (SELECT run, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END
        for c in string_split(k || ':' || run, '')]) AS bytes FROM r),
    h AS (SELECT run, n, {CRC.format('bytes')} AS h FROM b),
    o AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM o GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
    cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
    near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN w b ON a.less = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN w b ON a.less = b.word),
    best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
    form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n,
        CASE WHEN b.m >= 5 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form FROM w LEFT JOIN best b USING (word)),
    chain AS (SELECT word, word AS root FROM form UNION SELECT c.word, f.form FROM chain c JOIN form f ON c.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.root, f.n, CAST(n_near AS BIGINT) AS n_near, f.form_n FROM form f
    JOIN (SELECT c.word, c.root FROM chain c JOIN form f ON c.root = f.word WHERE f.form IS NULL) c USING (word)""",
    "op13_lexical_ranking": r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    s AS (SELECT count(*) AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
    p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
    i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
    q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM i) GROUP BY item, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p SEMI JOIN q USING (term) GROUP BY term), s),
    m AS (SELECT row, doc_id, 100 - 75 + ((75 * len(terms)::BIGINT * N) // L) AS m FROM d, s WHERE len(terms) > 0 AND doc_id IS NOT NULL),
    c AS (SELECT item, row, sum(w * times * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY item, row),
    t AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM c JOIN m USING (row) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t JOIN i USING (item) WHERE rank <= 10""",
    "op6_block_neighbours": """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score
        FROM u q JOIN u c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND q.n > 0 AND c.n > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_source_mixing": f"""
    WITH d AS (SELECT doc_id, lang, source, CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' ELSE 'print' END AS domain,
        len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
    leaves AS (SELECT 1 AS one, domain, lang, source, sum(tokens) AS total, 2 * sum(tokens) AS capacity FROM d GROUP BY domain, lang, source),
    "g-1" AS (SELECT 1 AS one, least(floor(sum(total) * 0.5), sum(capacity))::DOUBLE AS budget FROM leaves),
    {(divided_sql(0) + divided_sql(1) + divided_sql(2)).replace("g-1", '"g-1"')}
    aims AS (SELECT l.*, floor(budget)::BIGINT AS quota, floor(floor(budget) / total)::BIGINT AS whole FROM leaves l JOIN g2 USING (one, domain, lang, source)),
    runs AS (SELECT d.*, whole, quota - whole * total AS rest, sum(tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('17:' || whole || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
        FROM d JOIN aims USING (domain, lang, source))
    SELECT doc_id, lang, source, domain, tokens, CAST(e.epoch AS INTEGER) AS epoch FROM runs, (SELECT unnest([0, 1]) AS epoch) e
    WHERE e.epoch < whole OR e.epoch = whole AND run <= rest""",
    "op8_hyperminhash": """
    WITH RECURSIVE p AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+') AS parts FROM documents),
    w AS (SELECT doc_id, [x for x in parts if x <> ''] AS words FROM p),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
        ELSE [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] END) AS s FROM w),
    classes AS (SELECT min(doc_id) AS rep, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
    items AS (SELECT rep, n, unnest(s) AS item FROM classes),
    common AS (SELECT item, count(*) AS f FROM items GROUP BY item),
    ranked AS (SELECT rep, n, item, row_number() OVER (PARTITION BY rep ORDER BY f, item) AS place FROM items JOIN common USING (item)),
    heads AS (SELECT rep, n, item FROM ranked WHERE place <= n - ceil(n * 0.8) + 1),
    pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM heads a JOIN heads b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    both_ AS (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS i FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b),
    links AS (SELECT a, b FROM both_ WHERE 100 * i >= 80 * (na + nb - i)),
    reach AS (SELECT rep AS id, rep AS seen FROM classes UNION
        SELECT id, CASE WHEN a = seen THEN b ELSE a END FROM reach JOIN links ON a = seen OR b = seen),
    roots AS (SELECT id AS rep, min(seen) AS root FROM reach GROUP BY id),
    of_doc AS (SELECT doc_id, root FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) JOIN classes USING (s) JOIN roots USING (rep))
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
    FROM sets LEFT JOIN of_doc USING (doc_id)""",
}
