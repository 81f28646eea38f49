from __future__ import annotations

import random
import zlib

import pytest

from tessella.llm import toxicity as T

SCHEMA = "doc_id long, text string, score double, toxic string"


def corpus(n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "river", "house", "green", "walks", "often", "lamp"]) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "pathetic"] if i % 2 else ["verflixter", "verflixte", "verflixtes"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    odd = [(None, "idiot scum idiot scum"), (9001, None), (9002, ""), (9003, "word " * 50_000), (5, docs[5][1])]
    frame = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs + odd], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (77777, 1), (3, None)], "doc_id long, toxic int")
    rows = T.toxicity(frame, lab).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {r["doc_id"]: r for r in rows}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] == (i in set(held)) for i, _ in docs)
    assert sum(by[i]["predicted"] == int(i % 5 == 0) for i in held) / len(held) > 0.97
    assert by[9001]["score"] == by[9002]["score"] and by[9001]["predicted"] == 0 and by[9003]["predicted"] == 0
    assert by[None]["held_out"] is False and by[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= T.THRESHOLD) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame([(i, t, 0.0, "x") for i, t in docs], SCHEMA)
    scores = []
    for flip in (0, 1):
        lab = [(i, y ^ (flip if zlib.crc32(str(i).encode()) % 3 == 1 else 0)) for i, y in labels]
        scores.append(sorted((r["doc_id"], r["score"]) for r in T.toxicity(frame, spark.createDataFrame(lab, "doc_id long, toxic int")).collect()))
    assert scores[0] == scores[1]


def test_without_labels_or_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    frame = spark.createDataFrame([(1, "you idiot moron scum", 0.0, ""), (2, "a quiet house", 0.0, "")], SCHEMA)
    assert {r["doc_id"]: r["predicted"] for r in T.toxicity(frame, empty).collect()} == {1: 1, 2: 0}
    assert T.toxicity(frame.limit(0), empty).count() == 0
    assert [r["doc_id"] for r in T.keep_clean(frame, empty).collect()] == [2]


def ballots(n=3000, seed=1):
    rng = random.Random(seed)
    truth = [rng.random() < 0.3 for _ in range(n)]
    good = lambda y, p: (1 if y else -1) if rng.random() < p else (-1 if y else 1)
    rows = []
    for y in truth:
        copied = good(y, 0.6)
        rows.append([good(y, 0.95), good(y, 0.9), good(y, 0.85), copied, copied if rng.random() < 0.97 else -copied, copied if rng.random() < 0.97 else -copied])
    return rows, truth


@pytest.mark.parametrize("seed", range(1, 9))
def test_label_model_finds_good_and_copied_voters(seed):
    rows, truth = ballots(seed=seed)
    post, table, parent = T.label_model(rows)
    assert sum((p > 0.5) == y for p, y in zip(post, truth, strict=True)) / len(truth) > 0.95
    assert table[1, 0, 2] > table[1, 3, 2] and table[1, 0, 2] > 0.8
    links = {frozenset((k, p)) for k, p in enumerate(parent.tolist()) if p >= 0}
    assert len(links) == 2 and all(x <= {3, 4, 5} for x in links)  # the copies hang together, the others stand alone


def test_posteriors_against_enumeration():
    """The joint model, written out: P(class) times each voter's factor given its parent and the class."""
    rows, _ = ballots(400)
    post, table, parent = T.label_model(rows, rounds=200)
    p1 = float(post.mean())

    def factor(k, row, c):
        if parent[k] < 0:
            return table[c, k, row[k] + 1]
        w = post if c else 1 - post
        n = [sum(float(p) for p, r in zip(w, rows, strict=True) if r[parent[k]] == row[parent[k]] and r[k] == x) + 2 * table[c, k, x + 1] for x in (-1, 0, 1)]
        return n[row[k] + 1] / sum(n)

    for i in range(0, 400, 37):
        a, b = p1, 1 - p1
        for k in range(6):
            a, b = a * factor(k, rows[i], 1), b * factor(k, rows[i], 0)
        assert abs(a / (a + b) - post[i]) < 1e-3


def test_spanning_tree_against_all_trees():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        gain = rng.normal(0.3, 1, (5, 5))
        gain = gain + gain.T
        np.fill_diagonal(gain, -np.inf)

        def root(choice, k):
            for _ in range(6):
                k = choice[k] if choice[k] >= 0 else k
            return choice[k] < 0

        best = max(sum(gain[k, p] for k, p in enumerate(c) if p >= 0) for c in product(range(-1, 5), repeat=5) if all(p != k for k, p in enumerate(c)) and all(root(c, k) for k in range(5)))
        parent = T.spanning_tree(gain)
        assert abs(sum(gain[k, p] for k, p in enumerate(parent.tolist()) if p >= 0) - best) < 1e-9


def test_labels_only_calibrate(spark):
    """With the labels turned over, the order of scores is kept or turned as a whole; with labels drawn at random the posteriors stay."""
    docs, labels = corpus(300)
    gold = dict(labels)
    rows = [(T.vector(*T.evidence(t, frozenset()), ()), T.votes(*T.evidence(t, frozenset()), ()), gold[i]) for i, t in docs if i in gold]
    right, mixed = T.fit(rows, ()), T.fit([(x, v, i % 2) for i, (x, v, _) in enumerate(rows)], ())
    import numpy as np

    a, b = np.array(right.weights[1:]), np.array(mixed.weights[1:])
    assert abs(abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) - 1) < 1e-6
