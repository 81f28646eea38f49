"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling.

Every document lies in a cell (source, lang, topic) and brings its tokens, counted over the whole text. The weights
a(source) * b(lang) * c(topic) are raked until the weighted tokens have the target shares of sources, languages and
topics. Languages and topics are few, by their parameters; sources may be many, so they stay in a table: one row for a
source, holding its tokens by language and topic. A sweep sets every source's factor inside that table and brings the
len(langs) x len(topics) sums to the driver, which corrects the other two. Sources reach the documents by broadcast if
there are no more than MAX_BROADCAST of them, else by a join that adaptive execution can split.

A document stays with the probability min(1, rate * weight), `rate` being set so that about `fraction` of all tokens
stays; the draw is a hash of its id. What the cap at 1 cuts off is left to `weight / probability`, the weight in training.

Targets: sources and topics get shares in proportion to tokens ** `temper`, or topics as given; languages as given, with
"other" for all not named. Shares of languages or topics without tokens go to the others. A topic is a number from 0 to
len(TOPICS): that of a column, if one is named (null and other values are topic 0), else a stand-in, the commonest group of
first letters among the text's words (TOPICS), 0 for none of them.

Raking ends when every margin is within `close` of its target. If that isn't reached, because cells without tokens make
targets impossible together, the largest error is in the result and a warning says so.

Defined cases: a null or empty text has no tokens and topic 0; a null source or language is a value of its own and
goes with "other" for languages. A document without tokens in a cell without tokens has weight 1. A null id is hashed
like a value; repeated rows are drawn alike. An empty table gives an empty result. Other columns of any
name are kept by `mixed`.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessella.llm.common import cut, slices

TOPICS = ("abcde", "fghijklm", "nopqrs", "tuvwxyz")
LANGS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.14, "other": 0.01}
FRACTION, TEMPER = 0.8, 0.7
SWEEPS, CLOSE = 40, 1e-7
MAX_BROADCAST = 100_000
BINS = 4096


@dataclass(frozen=True)
class Raked:
    """Factors of the languages and topics, the table (source, a), the rate, and the largest error of a margin."""

    langs: tuple[str, ...]
    b: tuple[float, ...]
    c: tuple[float, ...]
    sources: DataFrame
    n_sources: int
    rate: float
    error: float


def measured(docs: DataFrame, text: str = "text", topic: str | None = None) -> DataFrame:
    """(doc, tokens, topic): each row of docs as a struct, so that no column clashes."""
    at, topic_at = docs.columns.index(text), None if topic is None else docs.columns.index(topic)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        group = np.zeros(256, np.int64)
        for k, letters in enumerate(TOPICS):
            for x in letters.encode():
                group[x] = group[x - 32] = k + 1
        white = np.zeros(256, bool)
        white[[32, *range(9, 14)]] = True
        for b in slices(batches):
            fields = b.column(0).flatten()
            raw = [x or b"" for x in fields[at].cast(pa.binary()).to_pylist()]
            data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)  # a blank after each text
            ends = np.cumsum([len(x) + 1 for x in raw])
            blank = white[data]
            starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, np.int64)
            doc = np.searchsorted(ends, starts, "right")
            counts = np.zeros((len(raw), len(TOPICS) + 1), np.int64)
            np.add.at(counts, (doc, group[data[starts]]), 1)
            topic = np.where(counts[:, 1:].max(1) > 0, counts[:, 1:].argmax(1) + 1, 0) if len(raw) else np.zeros(0, np.int64)
            if topic_at is not None:
                given = [0 if x is None else int(x) for x in fields[topic_at].to_pylist()]
                topic = np.array([x if 0 <= x <= len(TOPICS) else 0 for x in given], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts.sum(1)), pa.array(topic.astype(np.int32))], ["doc", "tokens", "topic"])

    return packed.mapInArrow(run, StructType([*packed.schema.fields, StructField("tokens", LongType()), StructField("topic", IntegerType())]))


def _lang(lang: Column, langs: tuple[str, ...]) -> Column:
    return F.when(lang.isin(*[x for x in langs if x != "other"]), lang).otherwise(F.lit("other"))


def rake(cells: DataFrame, langs: dict[str, float] | None = None, topics: dict[int, float] | None = None, temper: float = TEMPER, fraction: float = FRACTION, sweeps: int = SWEEPS, close: float = CLOSE) -> Raked:
    """Fit cells(source, lang, topic, tokens) to the targets."""
    import numpy as np

    langs = dict(langs or LANGS)
    names = tuple(langs)
    n_topics = len(TOPICS) + 1
    lang_no = F.array_position(F.array(*map(F.lit, names)), _lang(F.col("lang"), names)).cast("int") - 1
    slot = lang_no * n_topics + F.col("topic")
    width = len(names) * n_topics
    table = cells.withColumn("slot", slot).groupBy("source").agg(*(F.sum(F.when(F.col("slot") == k, F.col("tokens")).otherwise(0)).cast("double").alias(f"t{k}") for k in range(width)))
    table = cut(table.select("source", F.array(*(f"t{k}" for k in range(width))).alias("n")))
    share = F.pow(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), F.lit(temper))
    head = table.agg(F.count("*").alias("k"), F.sum(F.when(share > 0, share)).alias("z"), *(F.sum(F.col("n")[k]).alias(f"t{k}") for k in range(width))).first()
    total = np.array([head[f"t{k}"] or 0.0 for k in range(width)]).reshape(len(names), n_topics)
    if not total.sum():
        return Raked(names, (1.0,) * len(names), (1.0,) * n_topics, table.select("source", F.lit(1.0).alias("a")), head["k"], 1.0, 0.0)

    def reachable(wanted, mass):
        wanted = np.where(mass > 0, wanted, 0)
        return wanted / wanted.sum() if wanted.sum() else mass / mass.sum()

    want_b = reachable(np.array([langs[x] for x in names]), total.sum(1))
    want_c = reachable(np.array([topics.get(k, 0.0) for k in range(n_topics)]) if topics else total.sum(0) ** temper, total.sum(0))
    z = head["z"]

    def own(b, c) -> Column:
        """A source's factor, given those of languages and topics."""
        flat = np.outer(b, c).ravel().tolist()
        inner = F.aggregate(F.zip_with("n", F.array(*map(F.lit, flat)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.when(inner > 0, share / z / inner)

    def sums(b, c):
        rows = table.select(own(b, c).alias("a"), "n").where("a is not null")
        got = rows.agg(*(F.sum(F.col("a") * F.col("n")[k]).alias(f"t{k}") for k in range(width))).first()
        return np.array([got[f"t{k}"] or 0.0 for k in range(width)]).reshape(len(names), n_topics) * np.outer(b, c)

    b, c, error = np.ones(len(names)), np.ones(n_topics), 1.0
    for _ in range(sweeps):
        m = sums(b, c)
        error = float(max(np.abs(m.sum(1) - want_b).max(), np.abs(m.sum(0) - want_c).max()))
        if error < close:
            break
        for _ in range(20):  # both small margins for the sources' factors as they are
            f = np.where(m.sum(1) > 0, want_b / np.maximum(m.sum(1), 1e-300), 1)
            b, m = b * f, m * f[:, None]
            g = np.where(m.sum(0) > 0, want_c / np.maximum(m.sum(0), 1e-300), 1)
            c, m = c * g, m * g
    if error >= close:
        warnings.warn(f"raking stopped after {sweeps} sweeps with a margin off by {error:.2g}", stacklevel=2)
    b, c = np.array([float(f"{x:.12g}") for x in b]), np.array([float(f"{x:.12g}") for x in c])
    fitted = cut(table.select("source", "n", F.coalesce(own(b, c), F.lit(1.0)).alias("a")))
    flat = np.outer(b, c).ravel().tolist()
    spread = fitted.select("a", F.posexplode("n").alias("k", "t")).where("t > 0").select("t", (F.col("a") * F.array(*map(F.lit, flat))[F.col("k")] * float(total.sum())).alias("w"))
    by_bin = spread.groupBy(F.least(F.greatest(F.round((F.log2("w") + 64) * (BINS / 128)), F.lit(0)), F.lit(BINS)).alias("bin")).agg(F.sum("t").alias("t"), F.sum(F.col("t") * F.col("w")).alias("tw")).collect()  # BINS + 1 rows at most
    bins = sorted(((r["tw"] / r["t"], r["t"]) for r in by_bin), reverse=True)
    low, high = 0.0, 1 / min(w for w, _ in bins)
    for _ in range(60):
        rate = (low + high) / 2
        kept = sum(t * min(1, rate * w) for w, t in bins)
        low, high = (rate, high) if kept < fraction * total.sum() else (low, rate)
    scale = float(total.sum())
    return Raked(names, tuple(b.tolist()), tuple((c * scale).tolist()), fitted.select("source", "a"), head["k"], float(f"{high:.9g}"), error)


def drawn(docs: DataFrame, fit: Raked, doc_id: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """docs (as `measured` gives them) with weight, probability, sampled."""
    factors = fit.sources.select(F.col("source").alias("of_source"), "a")
    factors = F.broadcast(factors) if fit.n_sources <= MAX_BROADCAST else factors
    own_lang = F.array_position(F.array(*map(F.lit, fit.langs)), _lang(F.col("doc")[lang], fit.langs)).cast("int") - 1
    weight = F.coalesce("a", F.lit(1.0)) * F.array(*map(F.lit, fit.b))[own_lang] * F.array(*map(F.lit, fit.c))[F.col("topic")]
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc")[doc_id]), 11) / F.lit(float(1 << 53))
    out = docs.join(factors, F.col("doc")[source].eqNullSafe(F.col("of_source")), "left")
    out = out.withColumn("weight", F.bround(weight, 12)).withColumn("probability", F.least(F.lit(1.0), F.bround(F.col("weight") * fit.rate, 12)))
    return out.withColumn("sampled", u < F.col("probability")).drop("of_source", "a")


def _cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.col("doc.source").alias("source"), F.col("doc.lang").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))


def sampling_plan(docs: DataFrame, topic: str | None = None, **how) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) for every row of docs."""
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", *[topic] * (topic is not None)), topic=topic)
    rows = cut(rows.withColumn("doc", F.struct("doc.doc_id", "doc.source", "doc.lang")))
    out = drawn(rows, rake(_cells(rows), **how))
    return out.select("doc.doc_id", "doc.source", "doc.lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "sampled")


def mixed(docs: DataFrame, topic: str | None = None, **how) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    fit = rake(_cells(measured(docs, topic=topic)), **how)
    return drawn(measured(docs, topic=topic), fit).where("sampled").select("doc.*")
