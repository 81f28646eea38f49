"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on posterior labels.

1. Evidence. A text is lower-cased and cut into words; the words of the lexicons and of *stems* are counted. Stems are
   word beginnings that training texts marked toxic repeat and others don't; they stand for insults of languages that no
   lexicon covers, and are voters that were written by looking at labelled examples.
2. Voters. Every lexicon, every lexicon word, every stem and a few patterns vote toxic, clean or abstain.
3. Label model. A latent class with factors for the accuracies of the voters and for their correlations: given the class, a
   voter depends on one other, and which one is part of the model (a maximum spanning tree over the voters' mutual
   information given the class; links that don't pay for their parameters are left out). EM estimates all of it from the
   votes alone; labels take no part.
4. Classifier. Logistic regression on counts, fitted to the posterior labels. Gold labels of the fitted rows are only used to
   calibrate its scores (a scale and a shift, so that the order of texts doesn't change).

Fitted on `MAX_LABELLED` labelled rows at most, those with the smallest hash of their id; only rows whose
crc32(doc_id as text) mod 3 is not 1 count; `mine_stems` takes 64 stems at most from them. Scoring reads nothing but the text.

Defined cases: null and empty texts hold no evidence and get the score of a text without hits. A null doc_id is never
held out and never trained on. Labels that are null or belong to no document are ignored; if two label rows name one
document, both count; repeated rows are scored alike. Without training rows of both classes `PRIOR` is used. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, slices

#: Bound of the labelled sample that the classifier is fitted on.
MAX_LABELLED = 8000
THRESHOLD = 0.7
STEM = 5

# Seed lexicons of plain insults, by theme.
LEXICONS = {
    "wit": ["idiot", "moron", "stupid", "clown", "imbecile", "idiots", "morons", "stupidity"],
    "worth": ["trash", "scum", "loser", "worthless", "losers", "vermin"],
    "disgust": ["pathetic", "disgusting", "filthy", "despicable"],
}
WORD = re.compile(r"\w+")
SEEDS = frozenset(w for ws in LEXICONS.values() for w in ws)


@dataclass(frozen=True)
class Model:
    """stems: word beginnings in order; weights: of the features of `vector`."""

    stems: tuple[str, ...]
    weights: tuple[float, ...]


#: Used without training rows: dense hits make a text toxic.
PRIOR = Model((), (-4.0, 0.0, 5.0, 1.0, 0.0, *([0.2] * len(LEXICONS))))


def evidence(text: str | None, stems: frozenset[str]) -> tuple[int, Counter]:
    """The number of words, and how often each lexicon word and each stem (with a star) occurs."""
    words = WORD.findall((text or "").lower())
    found = Counter(w for w in words if w in SEEDS)
    if stems:
        found.update(s + "*" for s in [w[:STEM] for w in words if len(w) > STEM] if s in stems)
    return len(words), found


def dense(hits: int, n: int) -> bool:
    """Repeated hits, at least one in 200 words: chance hits of a long text are rarer."""
    return hits >= 2 and 200 * hits >= n


def vector(n: int, found: Counter, stems: tuple[str, ...]) -> list[float]:
    """Bias, one hit, dense hits, log of hits, rate of hits, then capped counts for each lexicon and stem."""
    hits = sum(found.values())
    groups = [sum(found[w] for w in ws) for ws in LEXICONS.values()] + [found[s + "*"] for s in stems]
    return [1.0, float(hits >= 1), float(dense(hits, n)), math.log1p(min(hits, 8)), min(1.0, 50 * hits / max(n, 1)), *(min(g, 3) / 3 for g in groups)]


def votes(n: int, found: Counter, stems: tuple[str, ...]) -> list[int]:
    """1 toxic, -1 clean, 0 abstains: lexicons, their words, stems (dense), dense hits, one in 100 words, different insults, no hit, sparse hits of stems."""
    hits, seeds = sum(found.values()), sum(found[w] for w in SEEDS)
    out = [int(any(found[w] for w in ws)) for ws in LEXICONS.values()]
    out += [int(found[w] > 0) for w in sorted(SEEDS)]
    out += [int(dense(found[s + "*"], n)) for s in stems]
    out += [int(dense(hits, n)), int(hits >= 2 and 100 * hits >= n), int(sum(found[w] > 0 for w in SEEDS) >= 2), -int(hits == 0), -int(hits > 0 and not seeds and not dense(hits, n))]
    return out


def repeated_stems(text: str | None) -> list[str]:
    """Word beginnings that a text repeats."""
    counts = Counter(w[:STEM] for w in WORD.findall((text or "").lower()) if len(w) > STEM and w not in SEEDS)
    return [s for s, c in counts.items() if c >= 2]


def mine_stems(sample: DataFrame, n1: int, n0: int, least: int = 5, log_odds: float = 3.0, most: int = 64) -> tuple[str, ...]:
    """Of sample(text, toxic), the `most` best word beginnings that at least `least` toxic texts repeat, with smoothed log odds above `log_odds`."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            found = [(s, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in repeated_stems(t)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["stem", "toxic"])

    n = sample.mapInArrow(run, "stem string, toxic int").groupBy("stem").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (n1 + 1)) - F.log((F.col("q") + 0.5) / (n0 + 1))
    best = n.where(F.col("p") >= least).withColumn("odds", odds).where(F.col("odds") > log_odds)
    return tuple(sorted(r["stem"] for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("p")), "stem").limit(most).collect()))


def spanning_tree(gain):
    """The parent of each voter (-1: none) in the forest of the largest gains; only positive ones count."""
    import numpy as np

    m = len(gain)
    parent = np.full(m, -1)
    best, via, open_ = np.full(m, -np.inf), np.full(m, -1), np.ones(m, bool)
    for _ in range(m):
        now = int(np.where(open_, best, -np.inf).argmax()) if np.isfinite(best[open_]).any() else int(open_.argmax())
        open_[now] = False
        parent[now] = via[now] if best[now] > 0 else -1
        better = open_ & (gain[now] > best)
        best[better], via[better] = gain[now][better], now
    return parent


def label_model(ballots, rounds: int = 40):
    """(posterior P(toxic) of each row, accuracies by class, voter, vote, and the parent of each voter) from votes alone.

    ballots: rows x voters of -1, 0, 1.
    """
    import numpy as np

    v = np.asarray(ballots, np.int64) + 1
    n, m = v.shape
    raw = v - 1 - (v - 1).mean(0)
    size = np.sqrt(np.maximum((raw**2).sum(0), 1e-9))
    alike = ((raw.T @ raw / size / size[:, None]) ** 2).sum(1)  # to begin with, voters that agree share a vote
    post = np.clip(0.5 + 0.45 * np.sign(((v - 1) / np.maximum(alike, 1)).sum(1)), 0.05, 0.95)
    hot = np.eye(3)[v].reshape(n, 3 * m)  # row, voter and vote
    seen = (hot.T @ hot).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)  # voter, voter, vote, vote
    parent, table = np.full(m, -1), None
    for turn in range(rounds):
        mass, joint = [], []
        for p in (1 - post, post):
            mass.append(p.sum())
            joint.append(((hot * p[:, None]).T @ hot).reshape(m, 3, m, 3).transpose(0, 2, 1, 3))  # voter, voter, vote, vote
        single = [np.einsum("jjkk->jk", j) for j in joint]
        table = np.stack([(s + 1.0) / (s + 1.0).sum(1, keepdims=True) for s in single])
        if turn % 5 == 0:  # which voters depend on which: pairs that agree more or less often than the classes explain
            share = np.array(mass) / n
            alone = [s / max(w, 1e-9) for s, w in zip(single, mass, strict=True)]
            expected = sum(w * a[:, None, :, None] * a[None, :, None, :] for w, a in zip(share, alone, strict=True))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.nansum(np.where(seen > 0, seen * np.log(seen / (n * expected)), 0), (2, 3))
            np.fill_diagonal(gain, -np.inf)
            least = max(4 * math.log(n), 0.25 * gain.max() if turn < 10 else 0)  # 8 parameters more, half the logarithm of the rows each; the strongest links come first
            parent = spanning_tree(gain - least)
        prior = np.clip(post.mean(), 0.001, 0.999)
        score = np.full(n, math.log(prior / (1 - prior)))
        for k in range(m):
            if parent[k] < 0:
                ratio = np.log(table[1, k] / table[0, k])[v[:, k]]
            else:  # smoothed towards the accuracy of the voter by itself
                given = [joint[c][parent[k], k] + 2.0 * table[c, k] for c in (0, 1)]
                given = [g / g.sum(1, keepdims=True) for g in given]
                ratio = np.log(given[1] / given[0])[v[:, parent[k]], v[:, k]]
            score += ratio
        last, post = post, 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if turn % 5 == 4 and np.abs(post - last).max() < 1e-6:
            break
    return post, table, parent


def logistic(x, y, ridge: float = 0.5, rounds: int = 40):
    """Weights of a logistic regression on soft labels, by Newton steps."""
    import numpy as np

    w = np.zeros(x.shape[1])
    damp = np.full(x.shape[1], ridge)
    damp[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(damp), x.T @ (y - p) - damp * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[list[float], list[int], int]], stems: tuple[str, ...]) -> Model:
    """The classifier from (features, votes, label) of labelled texts; PRIOR if a class is missing."""
    import numpy as np

    if len({y for _, _, y in rows}) < 2:
        return PRIOR
    post, _, _ = label_model([v for _, v, _ in rows])
    x, gold = np.array([x for x, _, _ in rows]), np.array([y for _, _, y in rows], float)
    raw = logistic(x, post)
    shift, scale = logistic(np.stack([np.ones(len(x)), x @ raw], 1), gold, ridge=1.0)
    weights = raw * max(scale, 0.05)
    weights[0] += shift
    return Model(stems, tuple(float(round(w, 9)) for w in weights))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows that aren't held out: those with the smallest hash of the id."""
    key = F.col("doc_id").cast("string")
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.crc32(key.cast("binary")) % 3 != 1)
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `most` rows of 12 bytes
    return found.select("text", "toxic")


def trained(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The classifier of the labelled rows of docs. Texts stay on the executors: the driver gets stems and numbers of `most` rows."""
    sample = cut(training_sample(docs, labels, most))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return PRIOR
    stems = mine_stems(sample, n[1], n[0])

    def run(batches):
        import pyarrow as pa

        held = frozenset(stems)
        for b in slices(batches):
            seen = [evidence(t, held) for t in b.column(0).to_pylist()]
            cols = [pa.array([vector(*e, stems) for e in seen], pa.list_(pa.float64())), pa.array([votes(*e, stems) for e in seen], pa.list_(pa.int32())), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, ["x", "v", "toxic"])

    rows = sample.mapInArrow(run, "x array<double>, v array<int>, toxic int").orderBy(F.xxhash64("x", "v", "toxic")).limit(most).collect()  # a repeated id may bring more
    return fit(sorted((list(r["x"]), list(r["v"]), r["toxic"]) for r in rows), stems)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, w = frozenset(model.stems), np.array(model.weights)
        for b in slices(batches):
            x = np.array([vector(*evidence(t, held), model.stems) for t in b.column(1).to_pylist()]).reshape(-1, len(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    scored = score_texts(docs, trained(docs, labels, most))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    model = trained(docs, labels, most)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, w = frozenset(model.stems), np.array(model.weights)
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            x = np.array([vector(*evidence(t, held), model.stems) for t in texts]).reshape(-1, len(w))
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
