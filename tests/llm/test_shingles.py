"""Near copies against a plain comparison of all pairs."""

import random

import numpy as np
import xxhash
import corpus_pipeline as C

from quillmark.llm import shingles, simhash
from quillmark.llm.components import connected


def plain_similar(a, b):
    def cut(text):
        words = text.lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    return 5 * len(cut(a) & cut(b)) >= 4 * len(cut(a) | cut(b))


def test_near_duplicates_follow_similarity(spark, empty):
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(500)]
    texts = []
    for family in range(12):
        words = rng.choices(vocabulary, k=rng.randint(30, 120))
        texts.append(" ".join(words))
        for changes in (1, 1, 2, 3, 6):
            other = list(words)
            for at in rng.sample(range(len(other)), changes):
                other[at] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(other))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j", "Short One", "short  one", "short two"]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similar(texts[i], texts[j])]
    codes = [simhash.fingerprint(t) for t in texts]
    assert any((codes[i] ^ codes[j]).bit_count() > 3 for i, j in similar)
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in similar:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i} and 12 < len(kept) < len(texts)
    assert C.near_duplicates(spark, empty, "").count() == 0


def test_rows_of_one_id_and_different_texts_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten"), (None, "x y z"), (1, "seven eight nine ten")], "doc_id long, text string")
    assert sorted(r["text"] for r in shingles.one_of_near_copies(docs).collect()) == ["one two three four five six", "seven eight nine ten", "x y z"]


def test_parities_bound_the_difference():
    rng = random.Random(7)
    for _ in range(200):
        one = {rng.randrange(1 << 64) for _ in range(rng.randint(0, 300))}
        two = {x for x in one if rng.random() < 0.8} | {rng.randrange(1 << 64) for _ in range(rng.randint(0, 60))}
        bits = [shingles.parities(np.array(sorted(s), dtype=np.uint64)) for s in (one, two)]
        assert sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(*bits)) <= len(one ^ two)


def test_families_of_near_copies_are_grouped_as_by_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(400)]
    texts = []
    for family in range(3):
        base = rng.choices(vocabulary, k=rng.randint(60, 140))
        for _ in range(60):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts.append(" ".join(words))
    cuts = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(cuts[i] & cuts[j]) >= 4 * len(cuts[i] | cuts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in shingles.near_copy_groups(docs).collect():
        got.setdefault(r["group"], set()).add(r["doc_id"])
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 3 < len(want) < len(texts)


def test_both_ways_of_dropping_rows_agree(spark, odd):
    grouped = shingles.near_copy_groups(odd)
    one, two = (simhash.kept_rows(odd, grouped, most) for most in (1_000_000, 0))
    assert one.columns == two.columns == odd.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_components_with_hubs(spark):
    rng = random.Random(4)
    links = [(0, rng.randint(1, 400)) for _ in range(300)] + [(401, rng.randint(402, 600)) for _ in range(200)] + [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(120)]
    links += [(n, n + 1) for n in range(1000, 1060)] + [(5, 5), (7, None)]
    root = {n: n for pair in links for n in pair if n is not None}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    linked = {n for a, b in links if b is not None and a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}


def components(n, links):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root
    return root


def test_stage_goes_through_the_gray_order_index(spark, monkeypatch):
    rng = random.Random(13)
    vocabulary = [f"w{n}" for n in range(300)]
    texts = []
    for family in range(4):
        base = rng.choices(vocabulary, k=300)
        for copy in range(30):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, whole = [], shingles.index_pairs
    monkeypatch.setattr(shingles, "index_pairs", lambda codes, limit: found.append((codes, limit, whole(codes, limit))) or found[0][2])
    groups = {r["doc_id"]: r["group"] for r in shingles.near_copy_groups(docs).collect()}
    (codes, limit, pairs), = found
    codes = {r["fp"]: r["sim"] for r in codes.collect()}
    sets = [shingles.shingle_hashes(t, 5) for t in texts]
    sims = {int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)): simhash.majority(s) for s in sets}
    assert limit == 3 and {k: v & (1 << 64) - 1 for k, v in codes.items()} == sims
    place = {fp: i for i, fp in enumerate(sims)}
    got = [(place[r["u"]], place[r["v"]]) for r in pairs.collect()]
    bits = list(sims.values())
    want = [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3]
    assert all((bits[i] ^ bits[j]).bit_count() <= 3 for i, j in got) and len(set(got)) < len(want)
    assert components(len(bits), got) == components(len(bits), want) and len(set(groups.values())) < len(sims)


def test_majority_is_the_fingerprint():
    text = " ".join(str(n) for n in range(700))
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(text.split()[i : i + 3]), 42) for i in range(698)], dtype=np.uint64)
    assert simhash.majority(hashes, block=100) == simhash.fingerprint(text) and simhash.majority(hashes[:0]) == 0
