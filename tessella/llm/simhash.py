"""SimHash near-duplicates: pigeonhole blocks, Hamming check, connected components.

Two fingerprints that differ in at most RADIUS of 64 bits, cut into `blocks` blocks, agree in at least
`blocks - RADIUS` whole blocks. Each fingerprint is dealt out once for every choice of that many blocks; those that
meet under one key are compared. Only distinct fingerprints take part, so exact copies cost one row. A key that more
than `crowd` distinct fingerprints share is not compared pair by pair: its members are dealt out again to the 65
fingerprints within one bit of them. Two members within two bits have such a neighbour in common, a neighbour has 65
members at most, and all of them are within two bits of each other, so a star to the smallest keeps the links whole.

`groups` is the operator for documents that resemble each other less closely: fingerprints of `WIDE` bits over five-word
shingles, cut into blocks of `BLOCK_BITS`. Pairs within `WIDE / BLOCK_BITS - 1` bits share a block for certain; others do
with a probability that falls with their distance (measured recall is in the README). Pairs are verified by the Hamming
distance that a Jaccard similarity of 0.8 has, which 1,536 bits give within about 0.02. Of a key, every member meets
`heads` of its fingerprints, the same in all blocks as far as they are there; those that resemble no head meet again
among themselves, with eight times the heads in each round, until none is left. So a group of near copies brings rows in
proportion to its members. This is done for the first blocks; what they leave apart `_missed` finds: over all blocks, members
of different components that share a key are compared inside tasks, in bounded parts of the key. So no pair that shares a
block and meets the threshold stays apart.

Defined cases: a null or empty text, or one of white space only, has the fingerprint zero and is linked like any other.
A null id keeps its row; ids that are null never name a component (a component of null ids only is null). Repeated rows
stay. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tessella.llm.common import cut, slices, stored

SEED = 42
BITS = 64
#: Shingles hashed at once, for bounded memory on very long texts.
SLICE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
        h = np.array([hashed(s, SEED) for s in map(b" ".join, runs)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            made = [fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x - (x >> 63 << 64) for x in made], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def block_keys(blocks: int, radius: int) -> list[int]:
    """A mask of bits for every choice of `blocks - radius` blocks."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


#: Fingerprints link at this many differing bits or fewer; crowded keys rely on its being two.
RADIUS = 2


def links(fps: DataFrame, blocks: int = 5, crowd: int = 256) -> DataFrame:
    """(u, v), u < v: enough pairs of distinct fingerprints within RADIUS bits to connect all that are linked.

    fps has a column fp of distinct signed longs. Pairs come from shared blocks; in crowded keys they come as stars.
    """
    masks = F.array(*(F.lit(_signed(m)) for m in block_keys(blocks, RADIUS)))
    dealt = fps.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("way", "key"))
    full = dealt.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = _spread(dealt, full, ["way", "key"], "fp")
    a, b = met.where(F.col("n") <= crowd), met.where(F.col("n") <= crowd).select("way", "key", F.col("fp").alias("other"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = a.join(b, ["way", "key"]).where((F.col("fp") < F.col("other")) & near).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    flips = F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    around = met.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    stars = around.groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = stars.select(F.col("fps")[0].alias("u"), F.explode("fps").alias("v")).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))
    return pairs.unionByName(stars).distinct()


#: Shares that the rows of one key are dealt to in joins with one row for each key, if all rows were of one key; adaptive
#: execution splits what is larger.
SHARES = 4


def _spread(rows: DataFrame, single: DataFrame, on: list[str], by: str) -> DataFrame:
    """rows joined with the one row of each key in `single`, the rows of a key dealt to SHARES by another column.

    Both sides are exchanged anew for this key, so adaptive execution can split what is still too large.
    """
    dealt = rows.withColumn("share", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int"))
    every = single.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(every, [*on, "share"]).drop("share")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): alternating large and small stars until nothing changes."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
    seen = now.agg(mark.alias("m")).first()["m"]
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("m", "u").alias("m"))
        large = _spread(both.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, seen = seen, now.agg(mark.alias("m")).first()["m"]
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int = 5, crowd: int = 256, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row per input row; component_id is the smallest doc_id reachable."""
    each = cut(fingerprints(docs, doc_id, text, shingle))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(fps.select("fp"), blocks, crowd))
    rooted = fps.join(found, fps.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = cut(rooted.join(named, "root").select("fp", "component_id"))
    return each.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


#: Bits of a wide fingerprint and of its blocks; similarity of two sets of shingles from which they are linked.
WIDE, BLOCK_BITS, SIMILARITY, HEADS = 1536, 24, 0.8, 1


def wide_fingerprint(text: bytes | None, shingle: int = 5, bits: int = WIDE) -> bytes:
    """A fingerprint of `bits` bits: each shingle's hash is stretched by a mixing step for every 64 of them."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return bytes(bits // 8)
    n = max(1, len(words) - shingle + 1)
    ones, step = np.zeros(bits, np.int64), np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE >> 6):
        part = words[at : at + (SLICE >> 6) + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
        h = np.array([hashed(s, SEED) for s in map(b" ".join, runs)], "<u8")[:, None] + step
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(31))).astype("<u8")
        rows = np.unpackbits(h.view(np.uint8).reshape(len(h), bits // 8), axis=1, bitorder="little")
        for k in range(0, len(rows), 255):  # sums of 255 bits fit a byte
            ones += rows[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes()


def bits_apart(similarity: float, bits: int = WIDE) -> int:
    """The expected Hamming distance of two equally large sets of that Jaccard similarity."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _dealt(nodes: DataFrame, block_bits: int, first: int, last: int | None = None) -> DataFrame:
    """(key, node, root): each row of nodes(node, fp, root) once for every block from `first` up to `last`."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            fps = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            width = block_bits // 8
            blocks = np.arange(fps.shape[1] // width)[first:last]
            low = np.zeros((b.num_rows, len(blocks)), np.int64)
            for k in range(width):
                low |= fps[:, blocks * width + k].astype(np.int64) << (8 * k)
            key = low | blocks.astype(np.int64) << block_bits
            node, root = (np.repeat(b.column(k).to_numpy(), len(blocks)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node), pa.array(root)], ["key", "node", "root"])

    return nodes.select("node", "fp", "root").mapInArrow(run, "key long, node long, root long")


def _meetings(dealt: DataFrame, heads: int) -> DataFrame:
    """(key, u, v, crowded): each node v of a key with those of the first `heads` nodes u of that key that come before it, in one order for all keys: a group of near copies shares many keys, and has few heads then.

    Two heads meet once, not once for each of them. A window group limit leaves `heads + 2` rows of a key in each task before
    the exchange, so a hot key is small there; its members are dealt to shares when the heads come back to them.
    """
    order = Window.partitionBy("key").orderBy("o", "node")
    some = dealt.withColumn("o", F.xxhash64("node")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= heads + 2)
    first = some.groupBy("key").agg(F.collect_list(F.struct("r", "o", "node")).alias("some")).where(F.size("some") > 1)  # heads + 2 at most
    first = first.select("key", F.transform(F.filter("some", lambda x: x["r"] <= heads), lambda x: F.struct(x["o"], x["node"])).alias("heads"), (F.size("some") > heads + 1).alias("crowded"))
    place = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("node"))
    met = _spread(dealt, first, ["key"], "node").select("key", F.filter("heads", lambda x: x < place).alias("heads"), F.col("node").alias("v"), "crowded")
    return met.select("key", F.explode(F.transform("heads", lambda x: x["node"])).alias("u"), "v", "crowded")


def _close(pairs: DataFrame, nodes: DataFrame, apart: int) -> DataFrame:
    """The distinct (u, v), u < v, of pairs whose fingerprints differ in at most `apart` bits."""

    def run(batches):
        import numpy as np

        for b in slices(batches, 20_000):
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u8").reshape(b.num_rows, -1) for k in (2, 3))
            yield b.select(["u", "v"]).filter(np.bitwise_count(x ^ y).sum(1) <= apart)

    ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = _spread(ordered, nodes.select(F.col("node").alias("u"), F.col("fp").alias("x")), ["u"], "v")
    both = _spread(left, nodes.select(F.col("node").alias("v"), F.col("fp").alias("y")), ["v"], "u")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


#: Blocks of the first pass.
FIRST = 8


def _linked(dealt: DataFrame, nodes: DataFrame, apart: int, heads: int) -> DataFrame:
    """(u, v): verified pairs of nodes that share a key of dealt(key, node)."""
    edges = []
    while True:
        met = cut(_meetings(dealt, heads))
        edges.append(found := cut(_close(met, nodes, apart)))
        crowded = met.where("crowded")
        if not crowded.take(1):
            return functools.reduce(DataFrame.unionByName, edges).distinct()
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked = crowded.join(both, ["u", "v"], "left_semi").select("key", F.col("v").alias("node"))
        done = linked.unionByName(crowded.select("key", F.col("u").alias("node"))).distinct()
        heads *= 8
        dealt = cut(crowded.select("key", F.col("v").alias("node")).distinct().join(done, ["key", "node"], "left_anti"))


def wide_links(nodes: DataFrame, similarity: float = SIMILARITY, block_bits: int = BLOCK_BITS, heads: int = HEADS, bits: int = WIDE) -> DataFrame:
    """(u, v): verified pairs of nodes(node, fp) that share a block, enough to connect what `groups` links.

    The first blocks find the large groups. `_missed` then compares, over all blocks, what these left apart, so a member comes
    back to a key of the other blocks once, and only where unlike texts share it.
    """
    apart = bits_apart(similarity, bits)
    alone = nodes.withColumn("root", F.col("node"))
    early = stored(_linked(_dealt(alone, block_bits, 0, FIRST).select("key", "node"), nodes, apart, heads), "links")  # a table, so that its size is known and not guessed from all joins before
    return early.unionByName(stored(_missed(early, nodes, apart, block_bits), "links")).distinct()


#: Members of a key that stand in one part of it at the mean.
PART = 1024


def _missed(edges: DataFrame, nodes: DataFrame, apart: int, block_bits: int, part: int = PART) -> DataFrame:
    """(u, v): pairs of nodes within `apart` bits that share a block, enough to connect all such pairs that are in different components of edges.

    The members of a key lie in one row, by parts of about `part` where they are more; every two parts of a key then meet in
    a row of their own, so a row is bounded and a large key is the work of many tasks. The members of different
    components are compared inside the task. A pair that is near joins its components there, so members that it connects are
    not compared again in this row, and a row gives fewer pairs than it holds components.
    """
    placed = stored(nodes.join(components(edges), "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root")), "placed")
    dealt = _dealt(placed, block_bits, 0)
    mixed = dealt.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / part).alias("parts")).where("a <> b")
    met = _spread(dealt, mixed.select("key", "parts"), ["key"], "node").withColumn("at", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = _spread(met, placed.select("node", "fp"), ["node"], "key")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct(F.least(x, "at").alias("p"), F.greatest(x, "at").alias("q")))
    packed = met.select("key", F.explode(others).alias("way"), F.struct("root", "node", "fp", "at").alias("m")).groupBy("key", "way").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1)

    def near(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches, 64):
            ends = b.column(0).offsets.to_numpy() - b.column(0).offsets[0].as_py()
            root, node, fp, at = b.column(0).flatten().flatten()
            root, node, at, fps = root.to_numpy().copy(), node.to_numpy(), at.to_numpy(), np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(root), -1)
            found = [np.empty((0, 2), np.int64)]
            for s, e, p, q in zip(ends[:-1], ends[1:], b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mine = s + np.argsort(node[s:e])  # one order for all keys, so that they give the same pairs
                x, y = (mine, mine) if p == q else (mine[at[mine] == p], mine[at[mine] == q])
                for k, i in enumerate(x.tolist()):
                    those = y[k + 1 :] if p == q else y
                    those = those[root[those] != root[i]]
                    close = those[np.bitwise_count(fps[those] ^ fps[i]).sum(1) <= apart] if those.size else those
                    if close.size:
                        joined, first = np.unique(root[close], return_index=True)
                        found.append(np.stack([np.minimum(node[i], node[close[first]]), np.maximum(node[i], node[close[first]])], 1))
                        root[mine[np.isin(root[mine], joined)]] = root[i]
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return packed.select("m", "way.p", "way.q").mapInArrow(near, "u long, v long").distinct()


def groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, shingle: int = 5, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(rows, table): rows(doc, node), stored, with each row of docs as a struct; and table(node, root), a root for each group of documents that resemble each other.

    node is a hash of the wide fingerprint.
    """
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in slices(batches):
            made = [wide_fingerprint(t, shingle) for t in b.column(0).flatten()[at].cast(pa.binary()).to_pylist()]
            node = [x - (x >> 63 << 64) for x in (xxhash.xxh64_intdigest(f, SEED) for f in made)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(made, pa.binary())], ["doc", "node", "fp"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))  # so that no column clashes
    rows = stored(packed.mapInArrow(run, StructType([*packed.schema.fields, StructField("node", LongType()), StructField("fp", BinaryType())])), "simhash")
    nodes = cut(rows.groupBy("node").agg(F.min("fp").alias("fp")))
    found = components(wide_links(nodes, similarity, heads=heads)).withColumnRenamed("node", "v")
    table = nodes.select("node").join(found, F.col("node") == F.col("v"), "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.drop("fp"), cut(table)


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Of each group one row of docs: that with the smallest id (null ids last), then the smallest hash of the row; of rows equal in all columns one."""
    rows, table = groups(docs, text, **how)
    rows = rows.withColumn("row", F.xxhash64("doc"))
    slim = cut(rows.select("node", F.col("doc")[doc_id].cast("long").alias("id"), "row"))
    place = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"), F.col("node").alias("d"))
    best = slim.groupBy("node").agg(F.min(place).alias("best"))  # before the join: a hot node is one row
    best = best.join(table, "node").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.d").alias("node"), F.col("best.c").alias("row"))
    best = cut(best.join(slim.groupBy("node", "row").agg(F.count("*").alias("n")), ["node", "row"]))
    kept = rows.join(best, ["node", "row"])
    single, again = kept.where("n = 1"), kept.where("n > 1")
    return single.unionByName(again.dropDuplicates(["node", "row"])).select("doc.*")
