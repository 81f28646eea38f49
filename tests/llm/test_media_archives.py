from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessella.llm import mpeg, warc


# ---- MPEG audio

@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 895, 896, 897, 1792, 50_000])
def test_stream_round_trip(n):
    payload = mpeg.padded(random.Random(n).randbytes(n))
    data = mpeg.write_stream(payload)
    s = mpeg.read_stream(data)
    assert s.payload == payload and len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] + bytes(len(payload) - n) == payload
    assert (s.skipped, s.bad_checksums, s.table[0]) == (0, 0, len(s.offsets))
    assert s.nanoseconds == len(s.offsets) * 24_000_000 and s.protected == len(s.offsets) + 1
    assert all(data[o : o + 2] == b"\xff\xfa" for o in s.offsets) and len(s.seek_points) == 100


def test_reader_finds_frames_again_and_counts_damage():
    data = mpeg.write_stream(mpeg.padded(b"a" * 6000))
    clean = mpeg.read_stream(data)
    cut = clean.offsets[3]
    noise = bytes(random.Random(1).choices(range(0, 255), k=500))
    s = mpeg.read_stream(data[:cut] + noise + data[cut:] + b"TAG" + b"t".ljust(125, b"\0"))
    assert s.skipped == 500 and len(s.offsets) == len(clean.offsets) and s.payload == clean.payload and s.tags["title"] == "t"
    hurt = bytearray(data)
    hurt[clean.offsets[2] + 8] ^= 4
    assert mpeg.read_stream(bytes(hurt)).bad_checksums == 1
    assert mpeg.read_stream(random.Random(2).randbytes(200_000)).offsets == []
    assert mpeg.read_stream(b"").offsets == [] and mpeg.read_stream(data[:5]).payload == b""


@pytest.mark.parametrize("n", [896, 128, 3 * 896, 2 * 896 + 128])
def test_letters_tag_in_the_payload_are_no_tag(n):
    hits = 0
    for shift in range(3):
        payload = (b"TAG"[shift:] + b"TAG" * n)[:n]
        data = mpeg.write_stream(payload)
        hits += data[-128:-125] == b"TAG"
        s = mpeg.read_stream(data)
        assert s.payload == payload and s.missing == s.skipped == 0 and "title" not in s.tags
        tagged = mpeg.read_stream(data + b"TAG" + b"t".ljust(125, b"\0"))
        assert tagged.payload == payload and tagged.tags["title"] == "t" and tagged.offsets == s.offsets and tagged.skipped == 0
    assert hits == 1


def test_missing_payload_is_counted():
    s = mpeg.read_stream(mpeg.write_stream(b"x" * 1792)[:-1])
    assert s.missing == 896 and len(s.payload) == 896


def test_crc_against_bits():
    rows = [random.Random(k).randbytes(19) for k in range(20)]

    def slow(raw):
        c = 0xFFFF
        for byte in raw:
            for k in range(7, -1, -1):
                top = c >> 15 & 1
                c = c << 1 & 0xFFFF
                if top ^ (byte >> k & 1):
                    c ^= 0x8005
        return c

    import numpy as np

    assert mpeg.crc16(np.array([list(r) for r in rows], np.uint8)).tolist() == [slow(r) for r in rows]


def test_other_versions_of_headers():
    head = 0xFFF30000 | 8 << 12 | 0 << 10 | 3 << 6  # MPEG-2, 64 kbit/s, 22050 Hz, mono
    assert mpeg._parse(head) == (208, 64, 22050, 576, 9)
    assert mpeg._parse(0xFFFB9000) == (417, 128, 44100, 1152, 32)
    assert mpeg._parse(0xFFFBF000) is None and mpeg._parse(0xFFFD9000) is None and mpeg._parse(struct.unpack(">I", b"abcd")[0]) is None


def frames(head, size, n, fill=b"\x11"):
    return [struct.pack(">I", head).ljust(size, fill) for _ in range(n)]


def test_durations_are_exact_fractions():
    data = b"".join(frames(0xFFFB9000, 417, 7))  # 44.1 kHz
    assert mpeg.read_stream(data).seconds == Fraction(7 * 1152, 44100)


def test_vbri_table_and_encoder_delay():
    first = bytearray(frames(0xFFFB9000, 417, 1, b"\0")[0])
    first[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 1105, 75, 4170, 10, 3, 2, 2, 3)
    first[62:68] = struct.pack(">HHH", 600, 601, 602)
    s = mpeg.read_stream(bytes(first) + b"".join(frames(0xFFFB9000, 417, 10)))
    assert (s.table_kind, s.table, s.seek_points, s.delay, len(s.offsets)) == ("VBRI", (10, 4170), (1200, 2402, 3606), 1105, 10)
    first = bytearray(frames(0xFFFB9000, 417, 1, b"\0")[0])
    first[36:48] = b"Info" + struct.pack(">II", 1, 10)
    first[48:72] = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg.read_stream(bytes(first) + b"".join(frames(0xFFFB9000, 417, 10)))
    assert (s.table_kind, s.table, s.delay, s.padding, len(s.offsets)) == ("Info", (10, 0), 576, 1000, 10)


def test_free_format_frames():
    data = b"".join(frames(0xFFFB0000, 700, 5))
    s = mpeg.read_stream(b"\0\xff\xfb" + data)
    assert s.offsets == [3 + 700 * i for i in range(5)] and s.skipped == 3 and s.samples == 5 * 1152
    assert mpeg.read_stream(data + b"TAG" + b"t".ljust(125, b"\0")).offsets == [700 * i for i in range(5)]


def test_media_query(spark):
    texts = [(1, None), (2, ""), (3, "é" * 5000), (None, "x"), (5, "same"), (5, "same")]
    df = spark.createDataFrame([(i, t, b"m") for i, t in texts], "doc_id long, text string, media binary")
    rows = mpeg.digests(df).collect()
    assert len(rows) == 6
    by = {r["doc_id"]: r for r in rows}
    raw = mpeg.padded("é".encode() * 5000)
    assert (by[3]["n_bytes"], by[3]["payload_bytes"], by[3]["payload_sha256"], by[3]["tail_crc32"]) == (10000, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    stream = mpeg.write_stream(raw)
    assert (by[3]["media_bytes"], by[3]["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert by[1]["n_bytes"] == 0 and by[1]["payload_bytes"] == 64 and by[1]["feature"] == by[2]["feature"]
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] == 5}) == 1
    assert mpeg.digests(df.limit(0)).count() == 0
    seen = mpeg.inspected(mpeg.encoded(df)).where("doc_id = 3").first()
    assert seen["payload"] == raw and seen["frames"] == len(seen["seek_offsets"]) and seen["duration_ns"] == seen["frames"] * 24_000_000
    assert Fraction(*seen["duration"]) == Fraction(seen["samples"], 48000)
    streams, index = mpeg.media_tables(df)
    assert {r["doc_id"]: len(r["seek_offsets"]) for r in index.collect()}[3] == seen["frames"] and streams.count() == index.count() == 6


# ---- WARC

def pages(rng, n=300):
    bodies = ["", "<p>same</p>", "<p>a</p>", *(f"<p>{rng.random()}</p>" for _ in range(40))]
    rows = [(i, rng.choice(["http://a.example/x", "https://b.example/y?q=1", f"http://c{i}.example/", "http://ü.example/ä\r\nz"]), rng.choice(bodies[:3] if i % 3 else bodies)) for i in range(n)]
    return [*rows, (1000, None, None), (None, "http://n.example", "<p>only null</p>"), (None, "http://n.example", "<p>a</p>"), (5000, "nourl", "x" * 300_000), rows[7], rows[7]]


def test_archives_against_brute_force(spark):
    rows = pages(random.Random(3))
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.captures(df).collect()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    count = {}
    for _, _, h in rows:
        count[h or ""] = count.get(h or "", 0) + 1

    def want(i, h):
        top = largest.get(h or "") if count[h or ""] > 1 else None
        revisit = top is not None and i != top
        raw = (h or "").encode()
        return (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)

    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted((want(i, h) for i, _, h in rows), key=str)
    order = sorted(got, key=lambda r: (r["range_no"], r["position"]))
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in order]
    assert keys == sorted(keys)
    assert warc.captures(df.limit(0)).count() == 0


def test_small_payloads_may_all_be_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.captures(df, least_bytes=5).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def ordered(got):
    return [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(got, key=lambda r: (r["range_no"], r["position"]))]


def test_a_thousand_runs_are_merged_in_passes(spark, monkeypatch, tmp_path):
    rng = random.Random(1)
    ids = [*range(3000), *(-5 - i * 10**9 for i in range(40)), *(7 + i * 10**9 for i in range(40)), None]
    df = spark.createDataFrame([(i, f"http://h{rng.randint(0, 30)}.example/", str(i)) for i in ids], "page_id long, url string, html string").repartition(1000)
    archives, runs = f"file://{tmp_path}/a", f"file://{tmp_path}/r"
    manifest = warc.write_archives(df.selectExpr("page_id", "url", "cast(html as binary) payload", "sha1(html) digest", "cast(null as long) largest", "cast(null as string) first_url"), archives)
    n_runs = manifest.count()
    assert n_runs > 900
    index = warc.index_archives(manifest.repartition(8), archives, runs, block=7).persist()
    n = index.select("run").distinct().count()
    passes = 0
    while n > 16:
        index, passes = warc.merge_pass(index, runs, 16, 7, 50), passes + 1
        now = index.select("run").distinct().count()
        assert now == -(-n // 16)
        n = now
    got = warc.merge_runs(index, runs, 16, 7, 50).collect()
    order = ordered(got)
    by_key = [(k, c, -(2**70) if i is None else i) for k, c, i in order]
    assert by_key == sorted(by_key) and sorted(x[2] for x in by_key) == sorted(-(2**70) if i is None else i for i in ids) and len({r["range_no"] for r in got}) > 1
    assert passes >= 1 or n_runs <= 16


def test_a_merge_opens_one_block_of_each_run(tmp_path, monkeypatch):
    folder, rows, open_now, most = f"file://{tmp_path}", [], [0], [0]
    for k in range(16):
        lines = [[f"u{j:04d}", "d", j * 16 + k, 0, "", "response", None, "a", j] for j in range(100)]
        rows += warc._write_run(folder, f"r{k:02d}", f"r{k:02d}", iter(lines), 10)
    real = warc._get

    def counted(where, name, offset=0, length=None):
        open_now[0] += 1
        most[0] = max(most[0], open_now[0])
        data = real(where, name, offset, length)

        class Block(bytes):
            def splitlines(self):
                yield from data.splitlines()
                open_now[0] -= 1

        return Block(data)

    import pyarrow as pa

    monkeypatch.setattr(warc, "_get", counted)
    table = [(0, 0, r[0], r[1], r[3], r[4], r[5], None, None) for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*table, strict=True)], [x.split()[0] for x in warc.PLACED.split(", ")])
    ((_, _, merged),) = [(t, n, [x[2] for x in lines]) for t, n, lines in warc.merged_ranges([batch], folder)]
    assert len(merged) == 1600 and most[0] == 16


def test_ids_of_records_are_unique_and_revisits_name_their_response(spark, tmp_path):
    archives = f"file://{tmp_path}/a"
    df = spark.createDataFrame([(*r, "c") for r in pages(random.Random(3))], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.decided(df.coalesce(1)).coalesce(1), archives).collect()
    found = [(h, b) for m in manifest for _, _, h, b in warc.read_records(warc._get(archives, m["archive"]))]
    ids = [h["WARC-Record-ID"] for h, _ in found]
    assert len(set(ids)) == len(ids) and {h["WARC-Type"] for h, _ in found} == {"warcinfo", "response", "revisit"}
    responses = {h["WARC-Record-ID"]: h for h, _ in found if h["WARC-Type"] == "response"}
    for h, block in found:
        if h["WARC-Type"] == "revisit":
            named = responses[h["WARC-Refers-To"]]
            assert named["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and named["X-Page-ID"] == h["X-Refers-To-Page-ID"] and block == warc.HTTP
        if h["WARC-Type"] != "warcinfo":
            assert h["Content-Type"] == "application/http;msgtype=response" and h["WARC-Block-Digest"] == "sha1:" + warc.digest32(block)


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 300):
        runs = [sorted((rng.randint(0, 50), j) for _ in range(rng.randint(0, 20))) for j in range(k)]
        assert [x[0] for x in warc.LoserTree([iter(r) for r in runs])] == sorted(x[0] for r in runs for x in r)


def test_records_are_readable_and_damage_is_seen(tmp_path):
    parts = [warc.record([("WARC-Type", "response"), ("X", str(i))], random.Random(i).randbytes(i * 40_000)) for i in range(3)]
    found = list(warc.read_records(b"".join(parts)))
    assert [f[3] for f in found] == [random.Random(i).randbytes(i * 40_000) for i in range(3)]
    assert [(f[0], f[1]) for f in found] == [(sum(map(len, parts[:i])), len(parts[i])) for i in range(3)]
    with pytest.raises(ValueError):
        list(warc.read_records(b"".join(parts)[:-3]))


def test_url_keys():
    assert warc.url_key("https://www.Blog.Example.com:80/A?b#c") == "com,example,blog)/a?b"
    assert warc.url_key("nourl") == "nourl)/"


def test_hot_payload_is_dealt_to_many_tasks(spark):
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("same").alias("html"))
    rows = warc.decided(df).groupBy("digest").agg(F.count("*").alias("n"), F.max("largest").alias("m")).collect()
    assert [(r["n"], r["m"]) for r in rows] == [(2000, 1999)]
