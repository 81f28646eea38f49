from __future__ import annotations

import hashlib
import random
import string
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import pieces, tokens
from tessella.llm.transducer import START, composed

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "it's", "''s", "!'s", "'re", "'rex", "'r", "'ve 'll 'l", "we've", "'s's", "x'", "'", "' s", "123 4", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext", "Σίσυφος ΟΔΟΣ", "é", "İ", "日本語", "🙂🙂", "a\x00b", "\x1c \x85 \xa0x",
    "½ Ⅷ ٣", "'T 'RE 'LL", "", "  ", "don't", "'lé", "a​b", "ǅ", "  a  b ", "a\nb", "a\tb", "x    ", "();\r\n", "  \n  \n", ">>>>>====", "a" * 3000, "<s> <unk> </s>", "<0x0A>",
]


def random_texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.choice((3, 10, 300, 900)))) for _ in range(n)]


def real_texts(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(WORDS)
    texts = ODD + random_texts("'''strevlmdTRE \n!?1é٣Σσ<|endoftext|>日ab", 800, 1) + real_texts(spark)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(WORDS).count(texts) == want
    assert [tokens.counter(WORDS).count([t])[0] for t in ODD] == want[: len(ODD)]


def test_counts_of_random_code_points_and_long_words_equal_the_library():
    lib, rng = Tokenizer.from_file(WORDS), random.Random(8)
    texts = ["".join(map(chr, (rng.choice((rng.randrange(32, 0xD800), rng.randrange(0x10000, 0x20000), rng.randrange(32, 127))) for _ in range(12)))) for _ in range(3000)]
    texts += [" \U0001436c's", "x\U00010d50y", "a" * 30_000, "haha" * 9000, "日本" * 5000, "!?" * 9000, "".join(rng.choice("etaoin") for _ in range(60_000)), "".join(rng.choice(string.ascii_lowercase) for _ in range(200_000))]
    assert tokens.counter(WORDS).count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_a_million_letters_are_counted_in_linear_time():
    rng = random.Random(9)
    word = "".join(rng.choice(string.ascii_lowercase) for _ in range(1 << 20))
    began = time.perf_counter()
    got = tokens.counter(WORDS).count([word])
    assert time.perf_counter() - began < 60
    assert got == [len(Tokenizer.from_file(WORDS).encode(word, add_special_tokens=False).ids)]


def test_chunk_maps_compose_to_one_walk():
    machine, rng = tokens.counter(WORDS).words, random.Random(10)
    for alphabet in (b"a", b"ab", b"etaoin", b"qwertyuiop", bytes(range(128, 256))):
        word = bytes(rng.choice(alphabet) for _ in range(3000))
        chunks = [word[i : i + 100] for i in range(0, len(word), 100)]
        assert composed(machine.chunk_maps(chunks, START), START) == machine.walk(word)


def test_transitions_after_a_reset():
    c, rng = tokens.Counter(WORDS), random.Random(11)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    want = [c.words.count(w.encode()) for w in words]
    for w, n in zip(words, want, strict=True):
        c.words.reset()
        assert c.words.count(w.encode()) == n


def test_state_maps_equal_one_walk():
    c = tokens.counter(WORDS)
    text = random_texts("'strevlmd !1é", 1, 7)[0] * 5
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, kinds = c.begins(points)
    state, marks = tokens.GAP, set()
    for i, k in enumerate(kinds.tolist()):
        out, state = int(c.emit[state * tokens.KINDS + k]), int(c.step[state * tokens.KINDS + k])
        marks |= {i - 1} if out >= tokens.BEGAN_BEFORE else set()
        marks |= {i} if out & 1 else set()
    assert set(starts.tolist()) - {len(text) - 1} == marks - {len(text) - 1}


def test_token_query_shape_and_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "hello there", 0), (3, "word " * 3000, 0), (3, "word " * 3000, 0)], "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, WORDS).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, False), (3, 15000, 3000, True), (3, 15000, 3000, True)], key=str)
    assert tokens.token_counts(df.limit(0), WORDS).count() == 0


def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + random_texts(string.ascii_letters[:12] + "   \n.,;▁é日🙂", 500, 2) + real_texts(spark)
    coded = pieces.table(PIECES).encode(texts)
    assert [np.frombuffer(c, "<i4").tolist() for c in coded] == lib.encode(texts)
    decoded = pieces.table(PIECES).decode(coded)
    assert all(d.decode("utf-8", "replace") == t for d, t in zip(decoded, texts, strict=True) if "▁" not in t)


def test_long_words_equal_the_library():
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(12)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("a", "ab", "etaoin", string.ascii_letters + string.digits + "+/", "日本語漢字文中国人一不", "0123456789", "=-_#") for n in (513, 700, 5000)]
    coded = pieces.Table(PIECES).encode(texts)
    assert [np.frombuffer(c, "<i4").tolist() for c in coded] == lib.encode(texts)


def test_a_million_characters_are_encoded_in_linear_time():
    rng = random.Random(13)
    word = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(1 << 20))
    began = time.perf_counter()
    (got,) = pieces.Table(PIECES).encode([word])
    assert time.perf_counter() - began < 120
    assert np.frombuffer(got, "<i4").tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(word)


def test_unigram_viterbi_against_brute_force():
    t = pieces.Table(PIECES, "unigram")
    rng = random.Random(4)
    words = ["".join(rng.choice("abtheino") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    names = {}
    for i in range(t.size):
        if np.isfinite(t.score[i]):
            names["".join(map(chr, t.points[i][: t.length[i]]))] = i

    def best(w):
        top = {0: 0.0}
        for j in range(1, len(w) + 1):
            top[j] = max(top[i] + t.score[names[w[i:j]]] for i in range(j) if w[i:j] in names)
        return top[len(w)]

    t.learn(words)
    for w in words:
        ids = np.frombuffer(t.known[w], "<i4")
        assert abs(sum(t.score[ids]) - best(w)) < 1e-6 and t.decode([t.known[w]])[0].decode() == w


def test_piece_query_shape_and_round_trip(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "hello  there\n", "c"), (3, "word " * 20_000, "c"), (4, "a▁b", "c")], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r for r in pieces.encode(df, PIECES).collect()}
    assert len(rows) == 5 and rows[1]["ids"] == [] and rows[2]["n_pieces"] == 0 and rows[3]["round_trip"] and not rows[4]["round_trip"]
    assert rows[None]["ids_sha256"] == hashlib.sha256(np.array(rows[None]["ids"], "<i4").tobytes()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, PIECES), PIECES).collect()}
    assert back[None] == "hello  there\n" and back[3] == "word " * 20_000 and back[4] == "a b"
    assert pieces.encode(df.limit(0), PIECES).count() == 0


def test_worker_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 50)
    t = pieces.Table(PIECES)
    texts = random_texts("abcdef ", 40, 9)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [np.frombuffer(c, "<i4").tolist() for c in t.encode(texts)] == lib.encode(texts)


def test_pairs_dropped_in_a_batch_are_not_missed(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 4)
    t = pieces.Table(PIECES)
    t.pair_keys, t.pair_answers = np.full(64, -1, np.int64), np.zeros(64, bool)
    words = sorted({w for x in random_texts("abtheinorsl ", 60, 5) for w in x.split()})
    drops, remember = [], t._remember

    def watched(keys, answers):
        before = t.n_pairs
        remember(keys, answers)
        drops.append(before > 0 and t.n_pairs == len(keys))

    monkeypatch.setattr(t, "_remember", watched)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for part in (words[::2], words):
        t.known.clear()
        t.learn([pieces.SPACE + w for w in part])
        assert [np.frombuffer(t.known[pieces.SPACE + w], "<i4").tolist() for w in part] == lib.encode(part)
    assert any(drops)


@pytest.mark.parametrize("ids", [[], [0], [1, 2]])
def test_decoding_of_special_ids(ids):
    assert pieces.table(PIECES).decode([np.array(ids, "<i4").tobytes()]) == [b""]
