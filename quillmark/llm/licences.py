"""Licence scan by diagonal voting; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower
from .licence_texts import PHRASES, TEMPLATES

#: What separates words (fixed value): ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a k-gram: for the method's templates, and for the base phrases.
K, K_BASE = 4, 2
#: Diagonals this far apart at most are one span, if its parts stand within the template's length.
SLACK = 2
#: Share of a template's words that a verified span holds.
SHARE = 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def _rolled(hashes: list[Column]) -> Column:
    """A cyclic polynomial over word hashes: one word further is a turn by a bit and two xors. Null if a word is missing."""
    total = hashes[0]
    for h in hashes[1:]:
        total = F.shiftleft(total, 1).bitwiseOR(F.shiftrightunsigned(total, 63)).bitwiseXOR(h)
    # Widths differ in their seed, so that one join serves both.
    return total.bitwiseXOR(F.lit(len(hashes)).cast("long"))


def _gram(k: int) -> list[Column]:
    return [F.col(f"w{i}") for i in range(k)]


def _shifted(hashes: str) -> Column:
    """Every place's word hash and those after it."""
    later = [F.slice(hashes, i + 1, F.greatest(F.size(hashes), F.lit(1))).alias(f"w{i}") for i in range(1, K)]
    return F.arrays_zip(F.col(hashes).alias("w0"), *later)


def _table(spark: SparkSession) -> DataFrame:
    """(h, template, exact, label, length, place, and the words' hashes): a row for each place of a k-gram in a template."""
    rows = [(n, n < len(PHRASES), label, text) for n, (label, text) in enumerate(PHRASES + TEMPLATES)]
    texts = spark.createDataFrame(rows, "template int, exact boolean, label string, text string")
    hashed = texts.withColumn("hashes", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
    places = hashed.select("template", "exact", "label", F.size("hashes").alias("length"), F.posexplode(_shifted("hashes")).alias("place", "x"))
    places = places.select("template", "exact", "label", "length", "place", "x.*")
    k = F.when(F.col("exact"), F.lit(K_BASE)).otherwise(F.lit(K))
    h = F.when(F.col("exact"), _rolled(_gram(K_BASE))).otherwise(_rolled(_gram(K)))
    named = [F.col(f"w{i}").alias(f"t{i}") for i in range(K)]
    return places.where(F.col("place") + k <= F.col("length")).select(h.alias("h"), "template", "exact", "label", "length", "place", *named)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))), ",")


def licence_spans(docs: DataFrame) -> DataFrame:
    """One row per document and verified or refused span, and one with nulls per document.

    Every word k-gram of every text is hashed by a rolling hash and joined to
    the templates' positions, a broadcast of some thousand rows fixed by
    ``licence_texts``. A match at word i of place p, its words' hashes compared
    one by one, votes for the diagonal i - p. Votes are summed per document,
    template and diagonal before the shuffle; neighbouring diagonals (insertions
    and omissions shift by one) are merged. A merged span is verified by the
    template's words that it holds in order: a place counts once, where it
    first stands, and only behind all places before it. Where verified spans
    of several templates overlap, those of the largest share hold. For the base
    phrases all k-grams must stand on one diagonal.

    Returns row, doc_id, n_words, template, exact, label, start (of the base
    phrase or the first diagonal), low, high (words of the span), share, ok.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _words(text).alias("words"))
    hashes = base.select("row", "doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    places = hashes.select("row", "doc_id", F.size("hashes").cast("long").alias("n_words"), F.posexplode_outer(_shifted("hashes")).alias("pos", "x"))
    places = places.select("row", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"), "x.*")
    keys = F.array(_rolled(_gram(K)), _rolled(_gram(K_BASE)))
    grams = places.select("*", F.posexplode(keys).alias("width", "h"))
    hits = grams.join(F.broadcast(_table(docs.sparkSession)), "h", "left")
    same = F.lit(True)
    for i in range(K):
        alike = F.col(f"w{i}") == F.col(f"t{i}")
        same = same & (alike if i < K_BASE else (alike | F.col("exact")))
    hit = F.coalesce(F.col("template").isNotNull() & same, F.lit(False))
    # A document without hits stays as the first key of its first place.
    hits = hits.where(hit | ((F.coalesce("pos", F.lit(0)) == 0) & (F.col("width") == 0)))
    hits = hits.withColumn("template", F.when(hit, F.col("template")))
    diagonal = F.when(F.col("template").isNotNull(), F.col("pos") - F.col("place"))
    lines = hits.withColumn("diagonal", diagonal).groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("exact").alias("exact"),
        F.first("label").alias("label"), F.first("length").alias("length"),
        F.collect_set(F.when(F.col("template").isNotNull(), F.col("place"))).alias("places"),
        F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    order = Window.partitionBy("row", "template").orderBy("low", "diagonal")
    before = lines.withColumns({"last": F.lag("diagonal").over(order), "reach": F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    apart = F.coalesce(
        F.col("exact") | (F.abs(F.col("diagonal") - F.col("last")) > SLACK) | (F.col("low") - F.col("reach") > F.col("length")), F.lit(True)
    )
    numbered = before.withColumn("span", F.sum(apart.cast("int")).over(order))
    # Verification: each place once, where it first stands, and behind all that come before it in the template.
    same_span = ["row", "template", "span"]
    first = ["doc_id", "n_words", "exact", "label", "length"]
    placed = numbered.select(*same_span, *first, "diagonal", "low", "high", F.explode_outer("places").alias("place")).groupBy(*same_span, "place").agg(
        *(F.first(c).alias(c) for c in first), F.min(F.col("place") + F.col("diagonal")).alias("pos"),
        F.min("diagonal").alias("diagonal"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    along = Window.partitionBy(*same_span).orderBy("place")
    ahead = F.max("pos").over(along.rowsBetween(Window.unboundedPreceding, -1))
    kept = placed.withColumn("counted", F.col("place").isNotNull() & (ahead.isNull() | (F.col("pos") > ahead)))
    since = F.last(F.when(F.col("counted"), F.col("place")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    k = F.when(F.col("exact"), F.lit(K_BASE)).otherwise(F.lit(K))
    covered = kept.withColumn("words", F.when(F.col("counted"), F.least(k, F.coalesce(F.col("place") - since, k))).otherwise(F.lit(0)))
    spans = covered.groupBy(*same_span).agg(
        *(F.first(c).alias(c) for c in first), F.sum("words").alias("words"),
        F.min("diagonal").alias("start"), F.min("low").alias("low"), (F.max("high") + F.max(k) - 1).alias("high"),
    )
    share = F.col("words") / F.col("length")
    tight = F.col("high") - F.col("low") + 1 <= 2 * F.col("length")
    ok = F.col("template").isNotNull() & F.when(F.col("exact"), share == 1).otherwise((share >= SHARE) & tight)
    judged = spans.withColumns({"share": share, "ok": ok, "rival": ok & ~F.coalesce("exact", F.lit(False))})
    # Of the method's spans that overlap, those of the largest share hold.
    by_place = Window.partitionBy("row", "rival").orderBy("low", "high", "template")
    reach = F.max("high").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("new", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int"))
    judged = judged.withColumn("group", F.sum("new").over(by_place))
    best = F.max("share").over(Window.partitionBy("row", "rival", "group"))
    judged = judged.withColumn("ok", F.col("ok") & (~F.col("rival") | (F.col("share") == best)))
    return judged.drop("span", "words", "length", "rival", "new", "group")


def licence_scan(docs: DataFrame) -> DataFrame:
    """Every document's licences.

    A document's score is the largest share among its verified spans, 0 without
    any; base phrases count 1. Null and empty texts have no words and no labels
    (empty strings). A very long text is scanned whole; its words are spread
    over rows. Repeated rows are scanned each; spans of equal share give all
    their labels; a null doc_id is kept; other columns are not read; an empty
    table gives an empty result. Returns doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score.
    """
    ok, exact = F.coalesce("ok", F.lit(False)), F.coalesce("exact", F.lit(False))
    return licence_spans(docs).groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"),
        F.count(F.when(ok & exact, 1)).alias("n_base"),
        F.min(F.when(ok & exact, F.col("start"))).alias("first_word"),
        F.max(F.when(ok & exact, F.col("start"))).alias("last_word"),
        _joined(F.collect_set(F.when(ok & exact, F.col("label")))).alias("base_labels"),
        _joined(F.collect_set(F.when(ok, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(ok, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def oracle() -> str:
    """DuckDB SQL for :func:`licence_scan`, with words in place of hashes."""
    texts = ", ".join(
        f"({n}, {str(n < len(PHRASES)).lower()}, '{label}', '{' '.join(text.split()).replace(chr(39), chr(39) * 2)}')"
        for n, (label, text) in enumerate(PHRASES + TEMPLATES)
    )
    words = lambda text: (
        f"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    )
    rows = "CASE WHEN exact THEN 2 ELSE 4 END".replace("2", str(K_BASE)).replace("4", str(K))
    return f"""
WITH t AS (SELECT template, exact, label, {words("text")} AS w, {rows} AS k FROM (VALUES {texts}) v(template, exact, label, text)),
tp AS (SELECT template, exact, label, len(w) AS length, k, place, w[place + 1:place + k] AS gram
  FROM (SELECT *, unnest(range(len(w))) AS place FROM t) WHERE place + k <= len(w)),
d AS (SELECT row_number() OVER () AS id, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT id, pos, k, w[pos + 1:pos + k] AS gram FROM (SELECT id, w, unnest(range(len(w))) AS pos FROM d), (VALUES ({K}), ({K_BASE})) q(k) WHERE pos + k <= len(w)),
hits AS (SELECT g.id, g.pos, tp.* EXCLUDE (gram), g.pos - tp.place AS diagonal FROM g JOIN tp ON g.k = tp.k AND g.gram = tp.gram),
lines AS (SELECT id, template, diagonal, any_value(exact) AS exact, any_value(length) AS length, min(pos) AS low, max(pos) AS high FROM hits GROUP BY ALL),
o AS (SELECT *, lag(diagonal) OVER w AS last, max(high) OVER (PARTITION BY id, template ORDER BY low, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM lines WINDOW w AS (PARTITION BY id, template ORDER BY low, diagonal)),
s AS (SELECT *, sum(CASE WHEN last IS NULL OR exact OR abs(diagonal - last) > {SLACK} OR low - reach > length THEN 1 ELSE 0 END)
  OVER (PARTITION BY id, template ORDER BY low, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM o),
p AS (SELECT id, template, span, label, exact, length, k, place, min(pos) AS pos, min(diagonal) AS diagonal, min(low) AS low, max(high) AS high
  FROM hits JOIN (SELECT id, template, diagonal, span, low, high FROM s) USING (id, template, diagonal) GROUP BY ALL),
c AS (SELECT *, coalesce(pos > max(pos) OVER (PARTITION BY id, template, span ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS counted FROM p),
n AS (SELECT *, least(k, coalesce(place - max(place) OVER (PARTITION BY id, template, span ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k)) AS words
  FROM c WHERE counted),
m AS (SELECT id, template, span, label, exact, length, sum(words)::DOUBLE / length AS share FROM n GROUP BY id, template, span, label, exact, length),
e AS (SELECT id, template, span, min(diagonal) AS start, min(low) AS low, max(high) + max(k) - 1 AS high FROM p GROUP BY id, template, span),
ok AS (SELECT * FROM m JOIN e USING (id, template, span) WHERE CASE WHEN exact THEN share = 1 ELSE share >= {SHARE} AND high - low + 1 <= 2 * length END),
i AS (SELECT *, coalesce((low > max(high) OVER (PARTITION BY id, exact ORDER BY low, high, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS new FROM ok),
j AS (SELECT *, sum(new) OVER (PARTITION BY id, exact ORDER BY low, high, template ROWS UNBOUNDED PRECEDING) AS island FROM i),
v AS (SELECT * FROM (SELECT *, max(share) OVER (PARTITION BY id, exact, island) AS best FROM j) WHERE exact OR share = best)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(v.label) FILTER (v.exact) AS n_base,
  min(v.start) FILTER (v.exact) AS first_word, max(v.start) FILTER (v.exact) AS last_word,
  coalesce(string_agg(DISTINCT v.label, ',' ORDER BY v.label) FILTER (v.exact), '') AS base_labels,
  coalesce(string_agg(DISTINCT v.label, ',' ORDER BY v.label), '') AS labels, coalesce(max(v.share), 0.0) AS score
FROM d LEFT JOIN v ON d.id = v.id GROUP BY d.id, d.doc_id, d.w
"""
