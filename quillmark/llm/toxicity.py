"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Labelled rows that training reads at most, chosen by hash of the id.
SAMPLE_ROWS = 40_000
#: A word of fewer training documents has the score of an unseen one.
LEAST_DOCS = 2
#: Standard errors that a word's excess over clean texts is lowered by.
SHRINK = 4.0
#: Counts that every word has in clean text beforehand.
SMOOTH = 1.0
WORD = re.compile(r"[^\W\d_]+")
BLOCK = 1 << 16


@dataclass
class Passage:
    """A maximal segment: word places [start, end), its score and the log of its E-value."""

    start: int
    end: int
    score: float
    log_expect: float = math.inf


@dataclass
class Model:
    """Token scores, the extreme-value parameters and the final logistic."""

    weights: dict[str, float] = field(default_factory=dict)
    default: float = -0.25
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = -3.0

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the maximal segments of their scores.

        Text is read in blocks; only words that score above zero can open a
        segment, and the sums between them come from one running total.
        """
        segments = Segments()
        get, default, n, pos = self.weights.get, self.default, 0, 0
        while pos < len(text):
            stop = min(len(text), pos + BLOCK)
            while stop < len(text) and text[stop].isalpha():
                stop += 1
            block = WORD.findall(text[pos:stop].lower())
            if block:
                segments.add(np.array([get(word, default) for word in block]))
            n += len(block)
            pos = stop
        return n, segments.found()

    def passages(self, n: int, segments: list[tuple[int, int, float]]) -> list[Passage]:
        """The maximal scoring segments with their E-values."""
        return [Passage(a, b, s, self.log_k + math.log(max(n, 1)) - self.rate * s) for a, b, s in segments]

    def evidence(self, n: int, passages: list[Passage]) -> float:
        """Summed -log E of the passages below 1; minus log E of the best, if none is."""
        strong = [-p.log_expect for p in passages if p.log_expect < 0]
        if strong:
            return sum(strong)
        best = max((p.score for p in passages), default=0.0)
        return min(0.0, self.rate * best - self.log_k - math.log(max(n, 1)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.shift))))

    def judged(self, text: str) -> tuple[float, list[Passage]]:
        """A text's score and its passages."""
        n, segments = self.scan(text)
        passages = self.passages(n, segments)
        return self.score(self.evidence(n, passages)), passages


class Segments:
    """All maximal scoring segments of a sequence of scores, in linear time, scores given part by part.

    The list of candidates keeps each one's left and right cumulative sums; a
    new candidate absorbs earlier ones back to the nearest that started lower,
    if that one's right sum is below its own.
    """

    def __init__(self) -> None:
        # start, end, left sum, right sum, nearest earlier candidate with a lower left sum
        self.stack: list[tuple[int, int, float, float, int]] = []
        self.total, self.n = 0.0, 0

    def add(self, scores: np.ndarray) -> None:
        sums = np.cumsum(scores) + self.total
        stack = self.stack
        places = np.flatnonzero(scores > 0)
        rights = sums[places]
        for place, left, right in zip((places + self.n).tolist(), (rights - scores[places]).tolist(), rights.tolist()):
            start = place
            while True:
                at = len(stack) - 1
                while at >= 0 and stack[at][2] >= left:
                    at = stack[at][4]
                if at < 0 or stack[at][3] >= right:
                    stack.append((start, place + 1, left, right, at))
                    break
                start, left = stack[at][0], stack[at][2]
                del stack[at:]
        self.n += len(scores)
        self.total = float(sums[-1]) if len(sums) else self.total

    def found(self) -> list[tuple[int, int, float]]:
        return [(a, b, right - left) for a, b, left, right, _ in self.stack]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of scores."""
    segments = Segments()
    if len(scores):
        segments.add(np.asarray(scores, dtype=float))
    return segments.found()


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, share: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Each word's log-odds of a toxic passage against clean text, an unseen word's, and the words' shares of clean text.

    ``toxic`` and ``clean`` count a word's training documents of either label,
    of ``n_toxic`` and ``n_clean`` words altogether. A toxic document is mostly
    made of the words of any other, so a passage's words are what toxic ones
    have in excess of clean ones, lowered by SHRINK standard errors. Both sides
    have a Dirichlet prior: for passages pseudo-counts of ``share`` times the
    excess, spread as words occur in documents of both labels alike, for clean
    text SMOOTH counts a word. An unseen word has the prior alone: the log of
    share / (1 + share), which is negative, and so is the mean over clean text.
    """
    ratio = n_toxic / max(n_clean, 1.0)
    excess = np.maximum(0.0, toxic - clean * ratio - SHRINK * np.sqrt(toxic + clean * ratio**2))
    unseen = math.log(share / (1 + share))
    if not excess.any():
        return np.full(len(toxic), unseen), unseen, clean / max(n_clean, 1.0)
    spread = (toxic / n_toxic + clean / max(n_clean, 1.0)) / 2
    passage = (excess / excess.sum() + share * spread) / (1 + share)
    usual = (clean + SMOOTH) / (n_clean + SMOOTH * len(clean))
    return np.log(passage / usual), unseen, usual


def karlin_rate(shares: list[tuple[float, float]]) -> float:
    """The positive root of sum p e^(rate s) = 1 over (share p, score s)."""
    if not any(s > 0 and p > 0 for p, s in shares) or sum(p * s for p, s in shares) >= 0:
        return 1.0
    total = lambda r: sum(p * math.exp(min(700.0, r * s)) for p, s in shares)
    low, high = 1e-9, 1.0
    while total(high) < 1:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not below zero) and shift of a logistic curve, by Newton's steps."""
    if len(np.unique(y)) < 2:
        return 1.0, -3.0 if not len(y) or y[0] == 0 else 3.0
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - ridge * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, share: float = 1.0) -> Model:
    """A model from at most ``sample_rows`` labelled rows outside the held-out fold.

    The rows are those of smallest id hash; a doc_id with both labels counts as
    toxic; rows without id or label are left out. Texts that are equal count
    once a label. ``docs`` is read once: ids are broadcast, and the sampled rows
    are written to the checkpoint folder. Four fifths of them, by text hash,
    give the words' scores; the rest, which no count has seen, calibrate. Null
    texts are left out, empty ones count; other columns, whatever their names,
    are not read. Without toxic training rows every text scores low.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    once = texts.join(F.broadcast(ids), "doc_id").groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"))
    train = cut(once.withColumn("checks", F.pmod(F.xxhash64("h"), F.lit(5)) == 0))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [set(WORD.findall(t.lower())) for t in batch["text"]]
            flat = [w for s in sets for w in s]
            yield pd.DataFrame({"word": flat, "toxic": np.repeat(batch["toxic"].to_numpy(), [len(s) for s in sets])})

    sides = {(r["toxic"], r["checks"]) for r in train.select("toxic", "checks").distinct().collect()}
    if not any(toxic for toxic, _ in sides):
        return Model()
    apart = {(1, False), (1, True), (0, False), (0, True)} <= sides
    learnt, kept_back = (train.where("not checks"), train.where("checks")) if apart else (train, train)
    counted = learnt.mapInPandas(words, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c")
    )
    counted = cut(counted)
    n_toxic, n_clean = (float(x or 0) for x in counted.agg(F.sum("t"), F.sum("c")).first())
    table = counted.where(F.col("t") + F.col("c") >= LEAST_DOCS).orderBy("word").toPandas()
    toxic, clean = table["t"].to_numpy(float), table["c"].to_numpy(float)
    scores, default, usual = log_odds(toxic, clean, n_toxic, n_clean, share)
    model = Model(dict(zip(table["word"], scores.tolist())), default)
    shares = list(zip(usual.tolist(), scores.tolist()))
    model.rate = karlin_rate([*shares, (max(0.0, 1 - float(usual.sum())), default)])
    sent = spark.sparkContext.broadcast(model)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            scans = [own.scan(t) for t in batch["text"]]
            found = [sorted((s for _, _, s in segments), reverse=True) for _, segments in scans]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in scans], "tops": found})

    seen = kept_back.mapInPandas(tops, "toxic int, n long, tops array<double>").toPandas()
    of_clean = seen[seen["toxic"] == 0]
    # Of n clean words, K n e^(-rate s) maximal segments score s or more, K n score above zero.
    if len(of_clean):
        model.log_k = min(0.0, math.log((int(of_clean["tops"].map(len).sum()) + 1) / (int(of_clean["n"].sum()) + 1)))
    evidence = [model.evidence(n, model.passages(n, [(0, 0, s) for s in t])) for n, t in zip(seen["n"], seen["tops"])]
    model.slope, model.shift = logistic(np.array(evidence), seen["toxic"].to_numpy().astype(float))
    sent.destroy()
    return model


FOUND = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:long,end:long,score:double,expect:double>>"


def score_documents(docs: DataFrame, model: Model, level: float = 0.05) -> DataFrame:
    """Every whole text's score, and its passages with an E-value below ``level``.

    Words are runs of letters, lower-cased; a passage is a range of word places.
    No shuffle; the model, whose words a bounded sample limits, is broadcast.
    Null and empty texts have no words and the lowest evidence of their length;
    very long texts are read in blocks. Of passages of equal score the first
    comes first. Repeated rows are kept; other columns are not read. A null
    doc_id counts as the empty string for the fold. An empty table gives an
    empty result. Returns doc_id, held_out, score, predicted, passages.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            judged = [own.judged(t or "") for t in batch["text"]]
            spans = [[{"start": p.start, "end": p.end, "score": p.score, "expect": math.exp(p.log_expect)} for p in found if p.log_expect < math.log(level)] for _, found in judged]
            scores = [score for score, _ in judged]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].array, "held_out": batch["held_out"], "score": scores,
                "predicted": [int(s >= 0.5) for s in scores], "passages": spans,
            })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return slim.mapInPandas(run, FOUND)


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows, then scores every document; see :func:`score_documents`."""
    ship(docs.sparkSession)
    return score_documents(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, with their columns as they are.

    Null and empty texts stay unless the model calls such texts toxic; very long
    texts are read whole, in blocks; repeated rows are judged alike; clashing
    column names do no harm; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = sent.value
        return pd.Series([own.judged(t or "")[0] for t in texts], dtype=float)

    return docs.where(score(F.col("text")) < 0.5)
