from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def slow_fingerprint(text):
    words, word = [], b""
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if b == 32 or 9 <= b <= 13:
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b])
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "ÄÖ a b c"), (7, "x " * 5000)]
    for g in range(12):
        base = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(rng.choice([30, 200, 600]))]
        for _ in range(rng.choice([1, 3, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
            rows.append((100 - len(rows) * 3, " ".join(words)))
    rows += [rows[8], (None, rows[8][1]), (None, None)]
    return rows


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, **how).collect()), key=str)
    fp = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(set(fp))
    least = {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fp, strict=True)), key=str)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_crowded_keys_lose_no_link(spark):
    check(spark, corpus(2), crowd=2)


def test_stars_link_what_pairs_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    roots = []
    for crowd in (1, 10**6):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, crowd=crowd)).collect()}
        roots.append(found)
    assert roots[0] == roots[1]
    slow = slow_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(slow[f], set()).add(f - (f >> 63 << 64))
    for members in groups.values():
        assert {roots[0].get(m, m) for m in members} == {min(members)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprint_equals_spark_xxhash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one"))).first()[0] == simhash._signed(simhash.fingerprint(b"ONE"))


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


# ---- groups of documents that resemble each other

def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def slow_wide(text, bits):
    words = (text or "").lower().split()
    counts, n = [0] * bits, max(1, len(words) - 4)
    if not words:
        return 0
    for i in range(n):
        h0 = xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42)
        for w in range(bits // 64):
            h = (h0 + (w + 1) * 0x9E3779B97F4A7C15) % 2**64
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
            h ^= h >> 31
            for k in range(64):
                counts[64 * w + k] += h >> k & 1
    return sum(1 << k for k in range(bits) if counts[k] * 2 > n)


def test_wide_fingerprints_against_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 6, 300, 1500):
        text = " ".join(f"w{rng.randrange(50)}" for _ in range(n))
        assert int.from_bytes(simhash.wide_fingerprint(text.encode()), "little") == slow_wide(text, simhash.WIDE)


def family(rng, copies, edits):
    base = [f"w{rng.randrange(10**5)}" for _ in range(300)]
    return [" ".join(base)] + [" ".join(edited(rng, base, edits)) for _ in range(copies)]


def test_groups_against_pairs(spark):
    rng = random.Random(3)
    texts = [t for n, edits in [(3, 1), (5, 2), (1, 3), (2, 0), (1, 30), (2, 25)] * 3 for t in family(rng, n, edits)] + [None, "", " ", "one", "one", "one two three four five six"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    rows, table = simhash.groups(df)
    root = {r["doc_id"]: r["root"] for r in rows.join(table, "node").select("doc.doc_id", "root").collect()}
    assert len(root) == len(texts)
    for i, a in enumerate(texts):
        for j in range(i):
            s = jaccard(a or "", texts[j] or "")
            assert root[i] == root[j] if s >= 0.9 else (root[i] != root[j] or s > 0.7), (i, j, s)


@pytest.mark.parametrize("heads", [1, 4])
def test_a_crowded_key_links_whom_few_heads_link(spark, heads):
    """Blocks of one byte: every key is crowded, few heads and more rounds must find what all pairs find."""
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(simhash.WIDE)
        fps += [base ^ sum(1 << k for k in rng.sample(range(simhash.WIDE), 60)) for _ in range(4)]
    nodes = spark.createDataFrame([(i, f.to_bytes(simhash.WIDE // 8, "little")) for i, f in enumerate(fps)], "node long, fp binary")
    got = {(r["u"], r["v"]) for r in simhash.wide_links(nodes, block_bits=8, heads=heads).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in got:
        assert (fps[u] ^ fps[v]).bit_count() <= simhash.bits_apart(0.8) and u < v
        parent[find(u)] = find(v)
    assert all(find(i) == find(i - i % 4) for i in range(len(fps))) and len({find(i) for i in range(len(fps))}) == 60


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(5)
    a, b = family(rng, 1, 1), family(rng, 0, 0)
    rows = [(7, a[0], 1), (3, a[1], 2), (3, b[0], 3), (3, b[0], 3), (None, b[0], 4), (None, "lonely text of five words", 5), (9, None, 6), (8, "", 7), (8, "", 7)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n int, node string")
    for cut in (df, df.repartition(5)):
        out = simhash.first_of_groups(cut)
        assert out.columns == df.columns
        assert sorted(r["n"] for r in out.collect()) == [2, 3, 5, 7]
    assert simhash.first_of_groups(df.limit(0)).count() == 0


def flipped(rng, fp, n, free):
    """fp with n bits of every block of 24 turned that isn't in `free`."""
    return fp ^ sum(1 << 24 * b + k for b in range(simhash.WIDE // 24) if b not in free for k in rng.sample(range(24), n))


@pytest.mark.parametrize("place", [{5}, {60}, {5, 60}])
def test_members_that_resemble_only_linked_members_are_linked(spark, place):
    """In a key that all share, chains hang on one text each: the next resembles only the one before, which a head has taken."""
    rng = random.Random(6)
    base, fps = rng.getrandbits(simhash.WIDE), []
    for _ in range(3):
        one = base ^ sum(rng.getrandbits(24) << 24 * b for b in range(simhash.WIDE // 24) if b not in place)
        fps.append([one])
        for _ in range(4):
            fps[-1].append(flipped(rng, fps[-1][-1], 3, place))
    apart = simhash.bits_apart(0.8)
    for seed in range(2):  # the order of the heads is that of the ids' hashes
        ids = random.Random(seed).sample(range(10**6), 15)
        nodes = spark.createDataFrame([(i, f.to_bytes(simhash.WIDE // 8, "little")) for i, f in zip(ids, sum(fps, []), strict=True)], "node long, fp binary")
        links = simhash.wide_links(nodes).collect()
        of = dict(zip(ids, sum(fps, []), strict=True))
        assert all((of[r["u"]] ^ of[r["v"]]).bit_count() <= apart for r in links)
        found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
        assert [{found.get(i) for i in ids[5 * k : 5 * k + 5]} for k in range(3)] == [{min(ids[5 * k : 5 * k + 5])} for k in range(3)]


def joined_rows(spark, work):
    """What work gives, and the rows that each of its joins made, by the first columns of its description."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        found = store.executionsList()
        return {found.apply(i).executionId() for i in range(found.size())}

    before, out, made = executions(), work(), []
    for e in executions() - before:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, made


@pytest.mark.parametrize("part", [simhash.PART, 16])
def test_unlike_texts_of_one_key_make_no_pairs_of_rows(spark, part):
    """One block that all texts share, and pairs among them that no link joins yet: what is near is found, and no join makes a row for each pair."""
    rng = random.Random(7)
    base, fps = rng.getrandbits(simhash.WIDE), []
    for _ in range(150):
        fps.append(base ^ sum(rng.getrandbits(24) << 24 * b for b in range(simhash.WIDE // 24) if b != 9))
        fps.append(flipped(rng, fps[-1], 3, {9}))
    schema = "node long, fp binary"
    nodes = spark.createDataFrame([(i, f.to_bytes(simhash.WIDE // 8, "little")) for i, f in enumerate(fps)], schema)
    linked = [(i, i + 1) for i in range(0, 100, 2)]
    edges = spark.createDataFrame(linked, "u long, v long")
    more = {} if part == simhash.PART else {"part": part}
    found, made = joined_rows(spark, lambda: sorted(tuple(r) for r in simhash._missed(edges, nodes, simhash.bits_apart(0.8), 24, **more).collect()))
    assert found == [(i, i + 1) for i in range(100, 300, 2)]
    assert max(made) < 3000, made


def test_unlike_texts_of_many_keys_come_back_to_a_key_once(spark):
    """100 unlike texts that share 20 of the later blocks: each is a row of each of these keys once, not again for each round of heads."""
    rng = random.Random(8)
    base = rng.getrandbits(simhash.WIDE)
    fps = [base ^ sum(rng.getrandbits(24) << 24 * b for b in range(simhash.WIDE // 24) if not 20 <= b < 40) for _ in range(100)]
    nodes = spark.createDataFrame([(i, f.to_bytes(simhash.WIDE // 8, "little")) for i, f in enumerate(fps)], "node long, fp binary")
    found, made = joined_rows(spark, lambda: simhash.wide_links(nodes).collect())
    assert found == []
    assert sum(made) < 3 * 2000, made  # 2,000 members of keys, joined with the keys and with the fingerprints


def test_near_texts_of_one_key_make_fewer_pairs_than_there_are_texts(spark):
    rng = random.Random(9)
    base = rng.getrandbits(simhash.WIDE)
    fps = [flipped(rng, base, 1, range(4, 64)) for _ in range(60)]
    nodes = spark.createDataFrame([(i, f.to_bytes(simhash.WIDE // 8, "little")) for i, f in enumerate(fps)], "node long, fp binary")
    found = simhash._missed(spark.createDataFrame([], "u long, v long"), nodes, simhash.bits_apart(0.8), 24).collect()
    assert {r["root"] for r in simhash.components(spark.createDataFrame(found, "u long, v long")).collect()} == {0}
    assert len(found) < 8 * 60, len(found)  # all 1,770 pairs are near
