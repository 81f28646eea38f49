"""Cross-tokenizer alignment: where two tokenizers end a token at the same byte, and which tokens stand between.

A text with a space before it is encoded by a byte-level BPE (A) and by a SentencePiece model (B, which adds the space
itself). An Arrow function cuts texts into units at spaces and newlines that stand alone (no token of either side reaches
over such a cut); the distinct units of some MB of text are aligned together, in arrays: one search gives the ends that both
sides share, they cut the ids of both sides into groups, and links are the products of groups. A text with runs of
blanks, blanks at its ends or very long words is one unit, encoded as a whole by the libraries. A unit ends where both
sides end, so a document's groups and links are those of its units in order. What documents have in common, the
counts of pairs over the corpus, is Spark's.

A pair of ids counts once for each document (row) that holds it linked. Counts are summed over the distinct pairs of
documents before and after the shuffle, so a pair that every document has costs one row for each task. They go back to the
links by a broadcast while there are at most `MAX_BROADCAST` pairs, and by a join of pairs that are summed for each
document beyond.

Defined cases: texts that are null or empty, and those whose joined token bytes are not their own (U+2581, which B takes
for a space), have no tokens: zeros and an empty digest; they add to no count. Rows that repeat an id, or a text, are
documents of their own. Ties for an id's highest count all count as best. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import json
import os
from functools import cached_property
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, stored
from tessella.llm.pieces import by_bytes

#: Known words a worker keeps; beyond, only those of the present row stay.
MEMORY = 300_000
#: Text whose distinct units are aligned together, text that is cut into words at once, and the longest word that is a unit.
ROW_BYTES, SLICE_BYTES, LONG_WORD = 3 << 20, 1 << 20, 256
#: Words that are encoded at once.
LEARNT = 20_000
#: Pairs of ids that are broadcast at most: 24 bytes each.
MAX_BROADCAST = 1_000_000
#: Characters that both of A's libraries class alike.
LATIN = "ɏ"
_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Both tokenizers, and the words that were encoded."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np
        import sentencepiece

        self.a_path = a_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte, spare = {}, 256  # of the printable character that stands for each byte
        for x in range(256):
            printable = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x
            byte[chr(x if printable else spare)], spare = x, spare + (not printable)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.fast = self._fast(spec)
        self.known: dict[str, bytes | None] = {}  # the number of A's ids in two bytes, the ids of A, the ids of B

    @cached_property
    def a(self):
        """A's own library; most texts never need it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(self.a_path)
        a.encode_special_tokens = True
        return a

    def _fast(self, spec: dict):
        """The same vocabulary in the faster library, if its ids follow the merges' ranks."""
        import public_tokenizers
        import tiktoken

        vocab = spec["model"]["vocab"]
        special = {t["id"] for t in spec["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """A's ids of each text."""
        if self.fast and max(map(max, texts), default="") <= LATIN:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Encode new words: those that begin with a newline as they are, the others with a space before them; None for a word that doesn't stand for itself."""
        import numpy as np

        self.known.update(dict.fromkeys(words))
        plain = [w for w in words if len(w) <= LONG_WORD and w.strip() and not w[-1].isspace() and not w[w[0] == "\n"].isspace()]
        for some in ([w for w in plain if max(w) <= LATIN], [w for w in plain if max(w) > LATIN]):
            texts = [w if w[0] == "\n" else " " + w for w in some]
            sides = [self.a_ids(texts), [y[1:] if w[0] == "\n" else y for w, y in zip(some, self.b.encode(some, num_threads=1), strict=True)]]  # before a newline B's space is a piece of its own
            raw = [t.encode() for t in texts]
            blobs, ok = [], np.ones(len(some), bool)
            for ids, spelled in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
                ok &= np.fromiter((b"".join([spelled[i] for i in own]) == r for own, r in zip(ids, raw, strict=True)), bool, len(raw))
                flat = np.array([i for own in ids for i in own], "<i4").tobytes()
                ends = np.cumsum([4 * len(own) for own in ids]).tolist()
                blobs.append([flat[s:e] for s, e in zip([0, *ends], ends, strict=False)])
            self.known.update((w, (len(x) // 4).to_bytes(2, "little") + x + y) for w, good, x, y in zip(some, ok.tolist(), *blobs, strict=True) if good)

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text that is one unit; nothing where a side's bytes are not the text's."""
        import numpy as np

        ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if any(b"".join([spelled[i] for i in own]) != b" " + text.encode() for own, spelled in zip(ids, (self.a_bytes, self.b_bytes), strict=True)):
            return b"", b""
        return np.array(ids[0], "<i4").tobytes(), np.array(ids[1], "<i4").tobytes()

    def units(self, texts: list[str | None], number: dict[str, int], found: list[tuple[bytes, bytes] | None]):
        """(sizes, flat): how many units each text has, and the numbers of all of them one after the other.

        number and found hold the units of a row so far, by word and as ids of both sides; what is new is added.
        """
        import numpy as np

        cut = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        here = set().union(*cut).difference(number)
        new = [w for w in here if w and w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known = {w: self.known[w] for w in chain(here, number) if w in self.known}
        for at in range(0, len(new), LEARNT):
            self.learn(new[at : at + LEARNT])
        self.known[""] = None
        for w in here:
            number[w] = len(found)
            if (blob := self.known[w]) is None:
                found.append(None)
            else:
                end = 2 + 4 * int.from_bytes(blob[:2], "little")
                found.append((blob[2:end], blob[end:]))
        for w in [w for w in new if len(w) > LONG_WORD]:
            self.known.pop(w, None)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int32, int(sizes.sum()))
        odd = np.fromiter((pair is None for pair in found), bool, len(found))
        text = np.repeat(np.arange(len(cut)), sizes)
        if (whole := np.unique(text[odd[flat]])).size:  # these texts are one unit each
            pairs = [self.whole(texts[i]) for i in whole.tolist()]
            kept = ~np.isin(text, whole)
            some = np.array([bool(p[0]) for p in pairs])
            text = np.concatenate([text[kept], whole[some]])
            flat = np.concatenate([flat[kept], len(found) + np.flatnonzero(some)]).astype(np.int32)
            order = np.argsort(text, kind="stable")
            flat, sizes = flat[order], np.bincount(text, minlength=len(cut))
            found += pairs
        return sizes, flat


def encoder(a_path: str, b_path: str) -> Encoder:
    """The encoder of two files; a worker keeps it."""
    if (a_path, b_path) not in _ENCODERS:
        _ENCODERS[a_path, b_path] = Encoder(a_path, b_path)
    return _ENCODERS[a_path, b_path]


def unit_groups(units: list[tuple[bytes, bytes]], a_length, b_length, b_size: int):
    """(n_a, n_b, n_groups, n_links, links, spelled) of units (ids of A, ids of B), all units at once: four counts for each unit, the links of all of them one after the other, and each unit's groups in digits.

    Ends are numbered by unit and byte, so the shared ones of all units are found by one search in sorted arrays; the
    last end of a unit is shared, so both sides number the groups alike.
    """
    import numpy as np

    ids, n, unit, ends = [], [], [], []
    for side, length in enumerate((a_length, b_length)):
        own = np.frombuffer(b"".join([u[side] for u in units]), "<i4")
        count = np.array([len(u[side]) // 4 for u in units], np.int64)
        at = np.repeat(np.arange(len(units)), count)
        total = np.concatenate([[0], np.cumsum(length[own])])
        ids.append(own)
        n.append(count)
        unit.append(at)
        ends.append(at << 32 | total[1:] - np.repeat(total[np.cumsum(count) - count], count))
    shared = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
    group = [np.cumsum(x) - x for x in shared]
    home = unit[0][shared[0]]  # the unit of each group
    size = [np.bincount(g, minlength=len(home)) for g in group]
    start = [np.cumsum(x) - x for x in size]
    times = size[1][group[0]]
    first = start[1][group[0]] - (np.cumsum(times) - times)
    links = np.repeat(ids[0].astype(np.int64), times) * b_size + ids[1][np.repeat(first, times) + np.arange(int(times.sum()))]
    n_groups = np.bincount(home, minlength=len(units))
    n_links = np.bincount(home, size[0] * size[1], len(units)).astype(np.int64)
    left, right = (list(map(str, x.tolist())) for x in ids)
    parts = [f"{left[i]}|{right[j]}" if p == q == 1 else f"{','.join(left[i : i + p])}|{','.join(right[j : j + q])}" for i, j, p, q in zip(*(x.tolist() for x in (*start, *size)), strict=True)]
    last = np.cumsum(n_groups)
    spelled = [";".join(parts[i:j]) for i, j in zip((last - n_groups).tolist(), last.tolist(), strict=True)]
    return n[0], n[1], n_groups, n_links, links, spelled


def aligned(docs: DataFrame, a_path: str, b_path: str, b_size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of each document; links: a * b_size + b of every linked pair of occurrences."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        e = encoder(a_path, b_path)
        for b in batches:
            for part in by_bytes(b, 1, ROW_BYTES):
                number: dict[str, int] = {}
                found: list = []
                sizes, flat = (np.concatenate(x) for x in zip(*(e.units(some.column(1).to_pylist(), number, found) for some in by_bytes(part, 1, SLICE_BYTES)), strict=True))
                *counts, n_links, links, spelled = unit_groups([pair or (b"", b"") for pair in found], e.a_length, e.b_length, b_size)
                number, found = {}, []
                doc = np.repeat(np.arange(len(sizes)), sizes)
                totals = [pa.array(np.bincount(doc, n[flat], len(sizes)).astype(np.int64)) for n in counts]
                last, each = np.cumsum(sizes), flat.tolist()
                digests = [hashlib.sha256(";".join([spelled[u] for u in each[i:j]]).encode()).hexdigest() if j > i else "" for i, j in zip((last - sizes).tolist(), last.tolist(), strict=True)]
                times = n_links[flat]
                own = links[np.repeat((np.cumsum(n_links) - n_links)[flat] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, times, len(sizes)).astype(np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), *totals, pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, pa.array(own))], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
                del sizes, flat, doc, each, spelled, links, own, totals
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def pair_counts(held: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked, and whether that is the most of its A id."""
    counts = held.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {b_size}")))  # an A id has b_size pairs at most
    return counts.withColumn("best", (F.col("n") == most).cast("long"))


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    made = aligned(docs, a_path, b_path, b_size, doc_id, text)
    held = stored(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256", "links"), "aligned")
    pairs = cut(pair_counts(held, b_size))
    links = held.select("row", F.explode("links").alias("pair"))
    if pairs.count() <= max_broadcast:
        scored = links.join(F.broadcast(pairs), "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    else:
        times = links.groupBy("row", "pair").agg(F.count("*").alias("times"))
        scored = times.join(pairs, "pair").groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return held.drop("links").join(scored, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
