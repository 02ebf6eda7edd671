"""Ranked search against a scorer that looks at every document for every query."""

import collections
import math
import random
import re

import numpy as np

from strandlake.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, item long, score long, rank int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def want(docs, queries, k):
    tf = [(i, collections.Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in tf]
    documents, every = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in queries:
        asked, found = collections.Counter(terms(text)), []
        for (doc, c), own in zip(tf, n, strict=True):
            m = 25 + 75 * own * documents // max(every, 1)
            score = sum(often * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, often in asked.items() if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -score) for r, (score, null, doc) in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "Ärger", "naïve", "x1", "B2B", "文字", "rare" + str(rng.randint(0, 40)), "to"])
    docs = [(i, rng.choice([" ", "-", "\t", "\x7f"]).join(word() for _ in range(rng.randint(1, 30)))) for i in range(300)]
    docs += [(400 + i, "same words in all copies") for i in range(40)]  # ties
    docs += [docs[3], (None, docs[4][1]), (None, "same words"), (900, None), (901, ""), (902, "!?"), (903, "long " + "of the rare1 " * 200_000)]
    rng.shuffle(docs)
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(20)]
    return docs, [*queries, (50, "same copies"), (50, "SAME Copies same"), (51, None), (52, ""), (53, "unheard"), (None, "naïve ärger Ärger")]


def found(spark, docs, queries, k):
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, t, 4) for i, t in queries], "item_id long, text string, doc_id int")
    return collections.Counter(tuple(r) for r in ranked.ranked_search(frame, asked, k=k).select("item_id", "rank", "doc_id", "score").collect())


def test_equals_brute_force(spark):
    docs, queries = corpus()
    assert found(spark, docs, queries, 10) == want(docs, queries, 10)


def test_shards_and_blocks_change_nothing(spark, monkeypatch):
    docs, queries = corpus()
    monkeypatch.setattr(ranked, "SHARD_BYTES", 300)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 12)
    assert found(spark, docs[:150], queries, 3) == want(docs[:150], queries, 3)


def test_empty_tables(spark):
    docs, queries = corpus()
    assert not found(spark, [], queries, 10)
    assert not found(spark, docs, [], 10)
    assert not found(spark, [(1, None), (2, "..")], queries, 10)


def test_best_is_safe_where_scores_tie():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores, ids, null = rng.integers(0, 4, 30), rng.permutation(30), rng.integers(0, 2, 30).astype(bool)
        some = [i for i in range(30) if scores[i] > 0]
        assert ranked.best(scores, ids, null, 7).tolist() == sorted(some, key=lambda i: (-scores[i], null[i], ids[i]))[:7]


def test_impacts_of_large_corpora():
    tf, n = np.array([3, 1]), np.array([2_000_000, 10])
    assert ranked.impacts(tf, n, 10**12, 10**15).tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * x * 10**12 // 10**15)) for t, x in ((3, 2_000_000), (1, 10))]
