"""Cross-tokenizer alignment against the public libraries and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import aligned

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    out, spare = {}, 256
    for x in range(256):
        shown = 33 <= x <= 126 or 161 <= x <= 172 or x >= 174
        out[chr(x if shown else spare)], spare = x, spare + (not shown)
    return out


def loops(rows):
    a, b, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    found = []
    for _, text in rows:
        groups = []
        if text:
            x = a.encode(" " + text, add_special_tokens=False)
            a_ids, y = x.ids, b.encode(text)
            left = [bytes(byte[c] for c in t) for t in x.tokens]
            right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
            if b"".join(left) == b"".join(right) == b" " + text.encode():
                ends = [list(accumulate(map(len, s))) for s in (left, right)]
                at = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    until = [ends[0].index(end, at[0]) + 1, ends[1].index(end, at[1]) + 1]
                    groups.append((a_ids[at[0] : until[0]], y[at[1] : until[1]]))
                    at = until
        found.append(groups)
    links = [[(p, q) for g in groups for p in g[0] for q in g[1]] for groups in found]
    counts = Counter(pair for own in links for pair in set(own))
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for (i, _), groups, own in zip(rows, found, links, strict=True):
        digest = hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest() if groups else ""
        out.append((str(i), sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(own), sum(counts[x] == most[x[0]] for x in own), sum(counts[x] for x in own), digest))
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit("x")).withColumn("n_a", F.lit(None)).repartition(2)
    got = aligned.alignment(df, A, B, **how).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == loops(rows)


ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\n\n\nb", "a\t\tb c", "\ta", "a\t \tb", "a \n b", "x\n", "\nx", "\n", "▁", "a▁b", "<s> </s> <unk>", "<|endoftext|> it", "it's we'll 'tis", "tab\tin word",
    "naïve café — “quotes” … €5", "日本語のテキスト です", "👩‍👩‍👧 emoji", "مرحبا بالعالم", "\x00 zero \x00byte", "\r\nwindows\r\nlines\r\n", " no break space ", " line sep", "ﬁ ligature Å Å", "0123456789 " * 3, "same same same", "a" * 1000, "ab " * 700, "word" * 200 + " end", "<0x0A> bytes", "﻿bom", "é combining", "ᲀ newer letter ꟛ",
]


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(None, "null id here"), (3, "same id"), (3, "same id"), (7, "the end")]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_both_ways(spark, seed):
    rng = random.Random(seed)
    bits = ["the", "tokenization", "’", " ", "  ", "\n", "\t", "é", "ß", "-", ",", "1984", "XyZ", "of", "http://a.b/c?d=e", "日", " ", "ing", "'s", "<s>", "_", "\n\n"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(40)))) for i in range(150)]
    check(spark, rows)
    check(spark, rows, max_broadcast=0)


def test_whole_table_and_long_text(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows.append((10_000, " ".join(t for _, t in rows[:80]).replace("  ", " ") + "  " + rows[5][1]))  # one unit of many tokens
    check(spark, rows)


def test_words_are_forgotten_in_between(spark, monkeypatch):
    monkeypatch.setattr(aligned, "MEMORY", 5)
    e = aligned.Encoder(A, B)
    whole = aligned.Encoder(A, B)
    for texts in (["one two three four"], ["five six seven eight nine ten one"], ["one two", "one  two", None]):
        found = []
        sizes, flat = e.units(texts, {}, found)
        at = 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            for side in (0, 1):
                assert b"".join(found[u][side] for u in flat[at : at + n].tolist()) == (whole.whole(t)[side] if t else b"")
            at += n


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert aligned.alignment(df, A, B).collect() == []


def test_units_are_aligned_in_arrays_as_in_loops():
    """Groups of one and of several tokens, a unit without ids in between, and shared ends at equal bytes of other units."""
    import numpy as np

    pack = lambda ids: np.array(ids, "<i4").tobytes()
    length = np.array([1, 2, 3])
    units = [([0, 1], [2]), ([], []), ([2, 0, 1], [0, 1, 2]), ([1, 1], [1, 1]), ([0, 0, 0, 2], [1, 0, 1, 0])]
    n_a, n_b, n_groups, n_links, links, spelled = aligned.unit_groups([(pack(a), pack(b)) for a, b in units], length, length, 10)
    assert n_a.tolist() == [2, 0, 3, 2, 4] and n_b.tolist() == [1, 0, 3, 2, 4]
    assert spelled == ["0,1|2", "", "2|0,1;0,1|2", "1|1;1|1", "0,0|1;0|0;2|1,0"]
    assert n_groups.tolist() == [1, 0, 2, 2, 3] and n_links.tolist() == [2, 0, 4, 2, 5]
    assert links.tolist() == [2, 12, 20, 21, 2, 12, 11, 11, 1, 1, 0, 21, 20]
