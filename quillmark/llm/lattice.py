"""Language-model scoring by subword lattice likelihood."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

MARK = "▁"
FLUSH_WORDS = 250_000
END = b""
ROWS = "row long, doc_id long, held_out boolean, n_tokens long, word binary, n long, n_known long, base double, score double"


#: A word of more characters is worked out by itself in little memory; others together with those of their length.
LONG_WORD = 2_048
#: Cells (words x ends x pieces) of one batch of the recursion.
CELLS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of an existing vocabulary with their lengths and hashes.

    Parameters of the model are numbered: each piece, then one byte (all 256
    weigh the same), then the end. The vocabulary's score of a piece is its
    rank; the prior weight is 1 / (rank + ``shift``).
    """

    def __init__(self, path: str, shift: float = 2.7) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {}
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and score > -1e8:
                ranks[piece] = -score
        self.number = {p: i for i, p in enumerate(ranks)}
        self.byte, self.end, self.size = len(ranks), len(ranks) + 1, len(ranks) + 2
        last = max(ranks.values()) + 1
        weights = np.array([1 / (r + shift) for r in ranks.values()] + [256 / (last + shift), 1 / shift])
        self.prior = weights / weights.sum()
        self.longest = max(map(len, ranks))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in ranks}):
            own = [p for p in ranks if len(p) == length]
            points = _points(own, length)
            hashes = np.zeros(len(own), dtype=np.uint64)
            for column in points.T:
                hashes = hashes * _BASE + column
            order = np.argsort(hashes)
            self.by_length[length] = hashes[order], np.array([self.number[p] for p in own])[order]

    def logs(self, shares: np.ndarray) -> np.ndarray:
        """Natural logs of the parameters' shares, a byte's for one of the 256."""
        out = np.log(shares)
        out[self.byte] -= math.log(256)
        return out

    def arcs(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """By length k: the piece (-1: none) that ends at each place of each text, for texts of one length."""
        width = points.shape[1]
        hashes = np.zeros_like(points)
        for k in range(1, min(self.longest, width) + 1):
            # of the k characters up to each place
            hashes = hashes[:, :-1] * _BASE + points[:, k - 1 :] if k > 1 else points.copy()
            known, numbers = self.by_length.get(k, (None, None))
            if known is None:
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            yield k, np.where(known[at] == hashes, numbers[at], -1)


def _points(texts: list[str], length: int) -> np.ndarray:
    """Codepoints of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


def _bytes_of(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def _sum_logs(terms: list[np.ndarray]) -> np.ndarray:
    """log of the sum of exponentials, place by place; minus infinity where there is none."""
    if len(terms) == 1:
        return terms[0]
    top = terms[0]
    for t in terms[1:]:
        top = np.maximum(top, t)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.exp(terms[0] - safe)
    for t in terms[1:]:
        total += np.exp(t - safe)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


class Lattice:
    """The segmentations of words into pieces, weighed by the shares of the pieces.

    A word is the mark and its characters; a character that is no piece is
    spelled by its bytes.
    """

    def __init__(self, vocabulary: Vocabulary, shares: np.ndarray) -> None:
        self.vocabulary, self.log = vocabulary, vocabulary.logs(shares)

    def words(self, words: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Each word's log of the summed weight of all its segmentations.

        With ``counts``, ``expected`` gets each parameter's expected use in all
        segmentations, so often as the word counts (the expectation step).
        """
        out = np.zeros(len(words))
        groups: dict[int, list[int]] = {}
        texts = [MARK + w.decode() for w in words]
        for i, text in enumerate(texts):
            if words[i] == END:
                out[i] = self.log[self.vocabulary.end]
                if expected is not None:
                    expected[self.vocabulary.end] += counts[i]
            else:
                groups.setdefault(len(text), []).append(i)
        for length, places in groups.items():
            if length > LONG_WORD:
                for i in places:
                    out[i] = self._alone(texts[i], 0.0 if expected is None else float(counts[i]), expected)
                continue
            most = max(1, CELLS // (length * min(length, self.vocabulary.longest)))
            for at in range(0, len(places), most):
                part = places[at : at + most]
                weight = None if expected is None else np.asarray(counts, dtype=float)[part]
                out[part] = self._batch(_points([texts[i] for i in part], length), weight, expected)
        return out

    def _batch(self, points: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Words of one length: forward recursion in log space, and backward if uses are asked for."""
        n, width = points.shape
        book = self.vocabulary
        # ends[j]: (k, parameter, log weight) of the arcs that end behind character j
        ends: list[list[tuple]] = [[] for _ in range(width)]
        single = np.full(points.shape, -1)
        log = np.append(self.log, -np.inf)  # number -1: no arc
        for k, found in book.arcs(points):
            if k == 1:
                single = found
            some = (found >= 0).any(axis=0)
            for j in np.flatnonzero(some).tolist():
                ends[j + k - 1].append((k, found[:, j], log[found[:, j]]))
        spelled = np.where(single < 0, self.log[book.byte] * _bytes_of(points), -np.inf)
        for j in np.flatnonzero((single < 0).any(axis=0)).tolist():
            ends[j].append((1, None, spelled[:, j]))
        ahead = [np.zeros(n)]
        for j in range(width):
            ahead.append(_sum_logs([ahead[j + 1 - k] + weight for k, _, weight in ends[j]]))
        total = ahead[-1]
        if expected is None:
            return total
        behind: list[list[np.ndarray]] = [[] for _ in range(width)] + [[np.zeros(n)]]
        for j in range(width - 1, -1, -1):
            back = _sum_logs(behind[j + 1]) if behind[j + 1] else np.full(n, -np.inf)
            behind[j + 1] = []
            for k, number, weight in ends[j]:
                path = weight + back
                behind[j + 1 - k].append(path)
                use = counts * np.exp(ahead[j + 1 - k] + path - total)
                if number is None:
                    expected[book.byte] += float((use * _bytes_of(points[:, j])).sum())
                else:
                    expected += np.bincount(number + 1, use, minlength=len(expected) + 1)[1:]
        return total


    def _alone(self, text: str, count: float, expected: np.ndarray | None) -> float:
        """One long word. Only the last sums are kept, all of them (eight bytes a character) if uses are asked for."""
        book, log, longest = self.vocabulary, self.log, self.vocabulary.longest

        def arcs(j: int) -> Iterator[tuple[int, int, float]]:
            """(k, parameter, log weight) of the arcs that end behind character j - 1."""
            for k in range(1, min(j, longest) + 1):
                number = book.number.get(text[j - k : j])
                if number is not None:
                    yield k, number, float(log[number])
                elif k == 1:
                    yield 1, book.byte, float(log[book.byte]) * len(text[j - 1].encode())

        def summed(terms: list[float]) -> float:
            top = max(terms)
            return top + math.log(sum([math.exp(t - top) for t in terms]))

        kept = np.zeros(len(text) + 1) if expected is not None else None
        ahead = deque([0.0], maxlen=longest)
        for j in range(1, len(text) + 1):
            ahead.append(summed([ahead[-k] + weight for k, _, weight in arcs(j)]))
            if kept is not None:
                kept[j] = ahead[-1]
        if kept is None:
            return ahead[-1]
        behind: deque[list[float]] = deque([[0.0]] + [[] for _ in range(longest)])
        for j in range(len(text), 0, -1):
            ways = behind.popleft()
            behind.append([])
            back = summed(ways) if ways else -math.inf
            for k, number, weight in arcs(j):
                behind[k - 1].append(weight + back)
                use = count * math.exp(kept[j - k] + weight + back - kept[-1])
                expected[number] += use * (len(text[j - 1].encode()) if number == book.byte else 1)
        return float(kept[-1])


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def shares_of(expected: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """The maximisation step: expected uses and ``strength`` pseudo-uses spread as the prior weights, as shares of 1."""
    return (expected + strength * prior) / (expected.sum() + strength)


def tokens(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased; the end is not in the list."""
    return text.encode().lower().split()


def base_log(count, total: int, distinct: int):
    """Add-one: log10 of (c + 1) / (N + V + 1)."""
    return np.log10((np.asarray(count, dtype=float) + 1) / (total + distinct + 1))


def gathered(batches: Iterator[pd.DataFrame], rows: int = 16_384, signs: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """Batches of words put together up to ``rows`` rows or ``signs`` bytes: small ones would waste the vectorised recursion."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["word"].map(len).sum())
        if sum(map(len, held)) >= rows or size >= signs:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct token and its count in training documents.

    Counted per task first, up to FLUSH_WORDS words at a time, then by word.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush() -> pd.DataFrame:
            words = list(seen[False]) + [w for w in seen[True] if w not in seen[False]]
            out = pd.DataFrame({"word": words, "c": [seen[False][w] for w in words]})
            seen[False].clear()
            seen[True].clear()
            return out

        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"]):
                words = tokens(text or "")
                words.append(END)
                seen[held].update(words)
                if len(seen[False]) + len(seen[True]) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return docs.mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def expected_uses(words: DataFrame, path: str, shares: np.ndarray) -> np.ndarray:
    """Expected uses of each parameter in all segmentations of ``words`` (word, c).

    Summed in each task, then over tasks; as many rows as the vocabulary has
    pieces, which the file fixes, reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = vocabulary(path)
        found = Lattice(book, shares)
        total = np.zeros(book.size)
        for batch in gathered(batches):
            found.words([bytes(w) for w in batch["word"]], batch["c"].to_numpy(), total)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"i": used, "uses": total[used]})

    rows = words.where("c > 0").mapInPandas(run, "i int, uses double").groupBy("i").agg(F.sum("uses").alias("uses")).toPandas()
    out = np.zeros(len(shares))
    out[rows["i"].to_numpy(np.int64)] = rows["uses"].to_numpy()
    return out


def lattice_scores(docs: DataFrame, path: str, head_share: int = 1 << 20, rounds: int = 2, strength: float = 1_000.0) -> DataFrame:
    """Every document's log10 probability, under add-one words and the lattice.

    All distinct tokens of the corpus are counted over the training documents
    (crc32 of the id mod 7 is not 2). Pieces start with the weights of the
    vocabulary's own scores; ``rounds`` of expectation and maximisation over all
    training words, with ``strength`` pseudo-uses of the first weights, give
    their shares. The forward recursion then runs once per distinct word: pieces
    don't cross words, so the sum over all of a document's segmentations, its
    marginal probability and its score, is the product of its words' sums.

    Documents meet counts and sums in two ways. Tokens that make up 1 /
    ``head_share`` of the corpus or more, of which there are ``head_share`` at
    most, are broadcast; the rest are joined by word, which spreads evenly since
    none of them is frequent.

    Null and empty texts: the end alone. A very long text is scored whole, and a
    very long word in little memory. A null doc_id counts as the empty string.
    Repeated rows, also of one doc_id, are scored each and count each. With no
    training text N = V = 0 and the first weights hold. An empty table gives an
    empty result; other columns are not read. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(key) % 7 == 2).alias("held_out"))
    words = cut(word_counts(slim))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    prior = vocabulary(path).prior
    shares = prior
    for _ in range(rounds if total else 0):
        shares = shares_of(expected_uses(words, path, shares), prior, strength)

    def recurse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Lattice(vocabulary(path), shares)
        for batch in gathered(batches):
            yield batch.assign(weight=sums.words([bytes(w) for w in batch["word"]]) / math.log(10))

    least = max(1, total / head_share)
    weighed = "word binary, c long, weight double"
    frequent = words.where(F.col("c") >= least).mapInPandas(recurse, weighed).collect()
    counts = np.array([r["c"] for r in frequent], dtype=float)
    known = {bytes(r["word"]): i for i, r in enumerate(frequent)}
    head = spark.sparkContext.broadcast((known, base_log(counts, total, distinct), np.array([r["weight"] for r in frequent])))
    del frequent

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base, score = head.value
        get = place.get
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                docs_out, rows, rare, n = [], [], [], []
                for row, doc_id, text, held in zip(part["row"], part["doc_id"].array, part["text"], part["held_out"]):
                    words = tokens(text or "")
                    words.append(END)
                    found = np.array([get(w, -1) for w in words])
                    tail = Counter([words[i] for i in np.flatnonzero(found < 0).tolist()])
                    found = found[found >= 0]
                    own = b" " + int(row).to_bytes(8, "big")
                    docs_out.append((row, doc_id, held, len(words), own, 0, len(found), base[found].sum(), score[found].sum()))
                    rows += [row] * len(tail)
                    rare += tail.keys()
                    n += tail.values()
                yield pd.DataFrame(docs_out, columns=ROW_NAMES)
                yield pd.DataFrame({"row": rows, "doc_id": pd.NA, "held_out": pd.NA, "n_tokens": pd.NA, "word": rare, "n": n, "n_known": pd.NA, "base": pd.NA, "score": pd.NA})

    scored = slim.withColumn("row", F.monotonically_increasing_id()).mapInPandas(local, ROWS)
    rest = words.where(F.col("c") < least).mapInPandas(recurse, weighed)
    own = F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1)))
    joined = scored.join(rest, "word", "left").select(
        "row", "doc_id", "held_out", "n_tokens",
        F.coalesce("n_known", F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))).alias("n_known"),
        F.coalesce("base", F.col("n") * own).alias("base"), F.coalesce("score", F.col("n") * F.col("weight")).alias("score"),
    )
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")


ROW_NAMES = [c.split()[0] for c in ROWS.split(", ")]
