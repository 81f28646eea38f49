"""WARC archives: writing, reading, and an external merge of capture indexes.

Writing. A digest of every payload is computed; an aggregation finds the largest id of each payload, and a join that
adaptive execution can split brings it back, so that the first of equal payloads is a response and the others are
revisits without a payload. A task writes its records, each a gzip member of its own, to archives of at most SEGMENT bytes
in the shared folder, a `warcinfo` record first; blocks are HTTP messages, with digests of block and payload. A file gets its
final name only when it is whole, and only files of tasks that succeeded are in the manifest, which is written as a
table. A task that is run again writes files of other names.

A record's id comes from its payload, page and URL, so a revisit can name its response (WARC-Refers-To) wherever that is
written. Rows that repeat all three get different ids within a task.

Reading. A task reads the archives it is given record by record, checks both digests, and writes a capture run: one line
per record, locally sorted by URL key and timestamp, with a sparse index of every BLOCK lines.

Merging. While there are more than FAN_IN runs, groups of FAN_IN are merged to larger stored runs; the last pass gives the
result. In each pass bounds taken from the sparse index cut the keys of a group into ranges, and a task takes the blocks
that reach into its range and merges them through a loser tree: one comparison per level for every line, one open block
per run, FAN_IN at most. A range has at least two blocks' lines for each run, so a block is read about one and a half
times. Lines come out in global order of (URL key, timestamp, id, place), and the ranges are numbered, so (range,
position) orders the capture histories of all URLs. A line is by construction in one range only.

Defined cases: a null payload is an empty one; empty payloads are equal to each other. Of rows that share the largest id
of their payload all are responses (they are the same capture); a null id is never the largest, and a payload of null
ids only is a response each time. A null URL is written as `urn:null` and keeps its row. Repeated rows are written and
returned as often as they come. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import new_folder, slices, stored

SEGMENT = 32 << 20
SLICE = 1 << 13
BLOCK = 500
RANGE = 20_000
#: Runs that are merged at once.
FAN_IN = 256
#: Bounds of ranges of a pass at most, of BOUND characters each; beyond, ranges grow, which only costs time.
SPLITTERS, BOUND = 100_000, 256
#: Lines that a merge hands on at once.
LINES = 5000
SALTS = 16
VERSION = "WARC/1.1"
#: Head of the message that carried a payload, and the fields of a warcinfo record.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INFO = b"format: WARC File Format 1.1\r\n"


# ---- records

def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """A sort key: host labels reversed, then path and query, lower case; fragments and `www.` go."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:cut].lower().split(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].lower() or "/")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n"])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each gzip member in an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:  # in slices: what is left over of a slice is copied, so slices are short
            if end >= len(data):
                raise ValueError("the last member is cut off")
            parts.append(z.decompress(view[end : end + SLICE]))
            end = min(end + SLICE, len(data))
        size = end - len(z.unused_data) - at
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield at, size, headers, rest[: int(headers["Content-Length"])]
        at += size


def record_id(digest: str, page: int | None, url: str, again: int = 0, part: int = 0) -> str:
    """The id of a record; `again` counts the rows before it in task `part` that repeat all of it."""
    name = json.dumps([digest, page, url, *([again, part] if again else [])]).encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name).digest()[:16], version=5)}>"


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name that nothing else has; it has that name only when it is whole."""
    where, root = _fs(folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/{name}.tmp") as out:
        out.write(data)
    where.move(f"{root}/{name}.tmp", f"{root}/{name}")
    return name


def _get(folder: str, name: str, offset: int = 0, length: int | None = None) -> bytes:
    where, root = _fs(folder)
    with where.open_input_file(f"{root}/{name}") as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


# ---- writing

def decided(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, largest, first_url): id and URL of the payload's response, null where nothing is revisited."""
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("urn:null")).alias("url"), payload.alias("payload"))
    digests = rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    best = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("best")  # of rows that share the largest id any may be named: the one with the last URL
    firsts = digests.where(F.col("size") >= least_bytes).groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", F.col("best.page_id").alias("largest"), F.col("best.url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a hot payload is dealt to SALTS tasks
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", "largest", "first_url")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows as `decided` gives them; the manifest (archive, records, bytes), kept as a table."""

    def run(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        held, size, count = [], 0, 0
        again: dict[tuple, int] = {}
        part = TaskContext.get().partitionId()

        def out():
            name = f"{uuid.uuid4().hex}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([_put(folder, name, b"".join(held))]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for b in slices(batches):
            for page, url, payload, digest, largest, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = largest is not None and page != largest
                mark = base64.b32encode(bytes.fromhex(digest)).decode()
                named = (digest, page, url)
                again[named] = again.get(named, -1) + 1
                block = HTTP + (b"" if revisit else payload)
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(*named, again[named], part)), ("WARC-Target-URI", json.dumps(url)[1:-1]), ("WARC-Date", _date(page)), ("Content-Type", "application/http;msgtype=response")]
                headers += [("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("WARC-Payload-Digest", f"sha1:{mark}"), ("X-Page-ID", json.dumps(page)), ("X-Payload-Length", str(len(payload)))]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(digest, largest, first_url)), ("X-Refers-To-Page-ID", str(largest))]
                if not held:
                    held.append(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _date(0)), ("Content-Type", "application/warc-fields")], INFO))
                    size += len(held[0])
                held.append(record(headers, block))
                size, count = size + len(held[-1]), count + 1
                if size >= SEGMENT:
                    yield out()
                    held, size, count = [], 0, 0
        if held:
            yield out()

    return stored(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def _date(page: int | None) -> str:
    """Captures have no time of their own: seconds after 2024-01-01 by id, so that later ids are later captures."""
    import datetime as dt

    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


# ---- reading

def index_archives(manifest: DataFrame, archives: str, runs: str, block: int = BLOCK) -> DataFrame:
    """Read the archives back and write sorted capture runs; the sparse index (run, first, last, offset, length, lines), kept as a table."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            for name in b.column(0).to_pylist():
                lines = []
                for offset, length, headers, content in read_records(_get(archives, name)):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    mark, page, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), json.loads(headers["X-Page-ID"]), int(headers["X-Payload-Length"])
                    payload = content.partition(b"\r\n\r\n")[2]
                    if f"sha1:{digest32(content)}" != headers["WARC-Block-Digest"] or (kind == "response" and (digest32(payload) != mark or len(payload) != size)):
                        raise ValueError(f"{name}: the record at {offset} doesn't match its digests")
                    url = json.loads(f'"{headers["WARC-Target-URI"]}"')
                    rest = [page, size, mark, kind, int(headers["X-Refers-To-Page-ID"]) if kind == "revisit" else None, name, offset, length]
                    lines.append([url_key(url), headers["WARC-Date"], *rest])
                lines.sort(key=_key)
                made = f"{uuid.uuid4().hex}.run"
                yield _index_batch(_write_run(runs, made, made, iter(lines), block))

    return stored(manifest.select("archive").mapInArrow(run, INDEX), "warc-index")


INDEX = "run string, first string, last string, file string, offset long, length long, lines long"


def _key(line: list) -> str:
    """The sort key of a line: (URL key, timestamp, id, archive, offset) as a string that sorts like it; null ids come first."""
    place = 0 if line[2] is None else line[2] + 2**63 + 1
    return f"{line[0]}\0{line[1]}\0{place:020d}\0{line[7]}\0{line[8]:020d}"


def _write_run(folder: str, run: str, name: str, lines: Iterator[list], block: int) -> list[tuple]:
    """Write sorted lines to a file; the rows of its sparse index. The file has its name only when it is whole."""
    where, root = _fs(folder)
    where.create_dir(root, recursive=True)
    index, at = [], 0
    with where.open_output_stream(f"{root}/{name}.tmp") as out:
        while part := list(itertools.islice(lines, block)):
            data = b"".join(json.dumps(line).encode() + b"\n" for line in part)
            out.write(data)
            index.append((run, _key(part[0]), _key(part[-1]), name, at, len(data), len(part)))
            at += len(data)
    where.move(f"{root}/{name}.tmp", f"{root}/{name}")
    return index


def _index_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string()] * 4 + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in INDEX.split(", ")])


# ---- merging

class LoserTree:
    """Merges sorted iterators: the loser of each match stays at its node, the winner goes on, log2(k) comparisons a line."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.nodes = [-1] * self.k  # losers; 0 holds the winner
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None and y is None else x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self.nodes[node] < 0:  # while the tree is built, the first to come waits
                self.nodes[node] = run
                return
            if self._less(self.nodes[node], run):
                self.nodes[node], run = run, self.nodes[node]
            node //= 2
        self.nodes[0] = run

    def __iter__(self):
        while (head := self.heads[self.nodes[0]]) is not None:
            yield head
            run = self.nodes[0]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


HISTORY = "range_no long, position long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
PLACED = "team long, range_no long, run string, first string, file string, offset long, length long, low string, high string"


def teams(index: DataFrame, fan_in: int) -> DataFrame:
    """index with the number of the group that its run is merged in, of at most fan_in runs."""
    order = Window.orderBy("run")  # names of runs only: one for each archive at most
    numbered = index.select("run").distinct().select("run", F.floor((F.row_number().over(order) - 1) / fan_in).alias("team"))
    return index.join(numbered, "run")


def placed(index: DataFrame, fan_in: int, block: int, least: int) -> DataFrame:
    """(PLACED): each block of index(INDEX, team), once for every range of its team that it reaches into."""
    import bisect

    total = index.agg(F.sum("lines").alias("n")).first()["n"] or 0
    size = max(least, 2 * block * min(fan_in, index.select("run").distinct().count()), total // SPLITTERS)
    every = 4  # sampled keys for each range: they are for balance only
    share = int(10**6 * min(1.0, every * block / size))
    some = index.where(F.pmod(F.xxhash64("file", "offset"), F.lit(10**6)) < share).groupBy("team").agg(F.sort_array(F.collect_list(F.substring("first", 1, BOUND))).alias("keys"))
    bounds = {r["team"]: sorted(set(r["keys"])) for r in some.select("team", F.filter("keys", lambda _, i: i % every == every - 1).alias("keys")).collect()}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for name, first, last, file, offset, length, team in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = bounds.get(team, [])
                for n in range(bisect.bisect_right(own, first), bisect.bisect_right(own, last) + 1):
                    rows.append((team, n, name, first, file, offset, length, own[n - 1] if n else None, own[n] if n < len(own) else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in PLACED.split(", ")])

    spark = index.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.select("run", "first", "last", "file", "offset", "length", "team").mapInArrow(run, PLACED)
    return dealt.repartition(parts, "team", "range_no").sortWithinPartitions("team", "range_no", "run", "first")


def merged_ranges(batches, runs: str) -> Iterator[tuple[int, int, Iterator[list]]]:
    """(team, range_no, merged lines) for each range in sorted batches of PLACED; at any time one block of each run is open."""

    def lines(blocks: list[tuple]) -> Iterator[tuple[str, list]]:
        for file, offset, length, low, high in blocks:
            for raw in _get(runs, file, offset, length).splitlines():
                row = json.loads(raw)
                key = _key(row)
                if (low is None or key >= low) and (high is None or key < high):
                    yield key, row

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for (team, number), of_range in itertools.groupby(rows(), key=lambda r: (r[0], r[1])):
        by_run = [[(r[4], r[5], r[6], r[7], r[8]) for r in of_run] for _, of_run in itertools.groupby(of_range, key=lambda r: r[2])]
        yield team, number, (row for _, row in LoserTree([lines(blocks) for blocks in by_run]))


def merge_pass(index: DataFrame, runs: str, fan_in: int = FAN_IN, block: int = BLOCK, least: int = RANGE) -> DataFrame:
    """The index of larger runs: every fan_in runs of index become one, stored in a file for each range."""

    def run(batches):
        made = uuid.uuid4().hex[:8]  # tasks that are run again write other files
        for team, number, lines in merged_ranges(batches, runs):
            yield _index_batch(_write_run(runs, f"team-{team}", f"{made}-{uuid.uuid4().hex}-{number}.run", lines, block))

    return stored(placed(teams(index, fan_in), fan_in, block, least).mapInArrow(run, INDEX), "warc-index")


def merge_runs(index: DataFrame, runs: str, fan_in: int = FAN_IN, block: int = BLOCK, least: int = RANGE) -> DataFrame:
    """The capture histories (HISTORY): every line of every run, in global order of (range_no, position)."""
    while index.select("run").distinct().count() > fan_in:
        index = merge_pass(index, runs, fan_in, block, least)

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in HISTORY.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for _, number, lines in merged_ranges(batches, runs):
            at = 0
            while rows := list(itertools.islice(lines, LINES)):
                cols = [pa.array([number] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))]
                at += len(rows)
                yield pa.RecordBatch.from_arrays(cols, names)

    return placed(index.withColumn("team", F.lit(0).cast("long")), fan_in, block, least).mapInArrow(run, HISTORY)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read them back, and merge their indexes: the capture histories of all pages."""
    spark = pages.sparkSession
    archives, runs = new_folder(spark, "warc"), new_folder(spark, "runs")
    manifest = write_archives(decided(pages, least_bytes), archives)
    spread = manifest.repartition(max(spark.sparkContext.defaultParallelism, 1))
    return merge_runs(index_archives(spread, archives, runs), runs)
