"""WARC archives with revisit records, and a merged index of capture histories.

Writing tasks sort their records by (URL key, time, page) and leave an archive
and an index run.  The runs are merged externally: key ranges are cut from
samples that every run carries, each merge task reads its range of up to
``FAN_IN`` runs and merges them with a loser tree into a longer run, and passes
repeat until each range has one.  The ranges in order are one sorted index.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.files import attempt_name, locate
from faultline.llm.shared import NULL_ID, id_or_least, ship, workspace, written

LEAST_PAYLOAD = 100  # smaller payloads are never revisits
FAN_IN = 32
RANGE_CAPTURES = 100_000
SPARSE, SAMPLES = 256, 16
READ_BYTES = 4 << 20
OUT_BYTES = 8 << 20
INDEX = "url_key string, captured string, page_id long, path string, offset long, length long, record_type string, payload_digest string"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query, without scheme, ``www.``, port or fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:www\d*\.)?|#.*$", "")
    host = F.regexp_extract(bare, r"^([^/?#:]*)", 1)
    path = F.regexp_replace(bare, r"^[^/?#:]*(?::\d*)?", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def captures(pages: DataFrame) -> DataFrame:
    """page, url, url_key, captured, html, digest and the page each equal payload refers to.

    Payloads of at least ``LEAST_PAYLOAD`` bytes are grouped by SHA-256 with a
    pre-aggregated minimum; only repeated ones come back to the pages.
    """
    p = pages.select(id_or_least("page_id").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= LEAST_PAYLOAD
    first = p.where(large).groupBy(F.col("digest").alias("same")).agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Small payloads never match: their join keys are spread by page.
    p = p.withColumn("same", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("page:"), F.col("page").cast("string"))))
    p = p.join(first, "same", "left").drop("same")
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page", F.lit(1_000_000_000)))
    return p.withColumn("url_key", url_key(F.col("url"))).withColumn("captured", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _record(page: int, url: str | None, captured: str, body: bytes, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers is not None else http + body
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {captured}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, stated payload length and payload of one compressed record."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    http, _, body = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return headers, length, body


class LoserTree:
    """k-way merge of sorted iterators: each step replays one path of losers to the root."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = len(sources)
        self.heads = [next(s, None) for s in sources]
        self.tree = [-1] * self.k  # tree[0] is the winner, the others hold losers
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        if b == -1:
            return False
        if a == -1:
            return True
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.tree[0]] is not None:
            w = self.tree[0]
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            self._replay(w)


class RunWriter:
    """A sorted run of JSON lines with a sparse index beside it."""

    def __init__(self, uri: str):
        self.uri, self.n, self.at, self.sparse = uri, 0, 0, []
        fs, path = locate(uri)
        self.out = fs.open_output_stream(path, compression=None)

    def add(self, entry: tuple) -> None:
        if self.n % SPARSE == 0:
            self.sparse.append([list(entry[:3]), self.at])
        line = (json.dumps(entry) + "\n").encode()
        self.out.write(line)
        self.at += len(line)
        self.n += 1

    def close(self) -> list[str]:
        """Finish the run; evenly spaced keys of it."""
        self.out.close()
        fs, path = locate(self.uri + ".sparse")
        with fs.open_output_stream(path) as out:
            out.write(json.dumps(self.sparse).encode())
        step = max(1, -(-len(self.sparse) // SAMPLES))
        return [json.dumps(k) for k, _ in self.sparse[::step]]


def read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run with low <= key < high, from the sparse place before ``low`` on."""
    fs, path = locate(uri)
    begin = 0
    if low is not None:
        with fs.open_input_file(path + ".sparse") as f:
            sparse = json.loads(f.readall())
        k = bisect_left([tuple(x) for x, _ in sparse], low) - 1
        begin = sparse[k][1] if k >= 0 else 0
    with fs.open_input_file(path) as f:
        f.seek(begin)
        rest = b""
        while block := f.read(1 << 18):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                entry = tuple(json.loads(line))
                if low is not None and entry[:3] < low:
                    continue
                if high is not None and entry[:3] >= high:
                    return
                yield entry


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one archive and one index run per task; manifest: run, n, samples."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or workspace(spark, "warc")

    def write(batches):
        out = run = None
        at = 0
        for batch in batches:
            for page, url, captured, html, digest, refers, key in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = attempt_name(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz")
                    fs, local = locate(path)
                    out, run = fs.open_output_stream(local, compression=None), RunWriter(path + ".run")
                refers = None if refers == page else refers
                raw = _record(page, url, captured, html.encode(), digest, refers)
                out.write(raw)
                run.add((key, captured, page, path, at, len(raw), "response" if refers is None else "revisit", digest))
                at += len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"run": [run.uri], "n": [run.n], "samples": [run.close()]})

    rows = captures(pages).select("page", "url", "captured", "html", "digest", F.col("first").alias("refers"), "url_key")
    ordered = rows.sortWithinPartitions("url_key", "captured", "page", "html")
    return written(ordered.mapInArrow(write, "run string, n long, samples array<string>"), "runs")


def merge_index(manifest: DataFrame, folder: str | None = None, *, fan_in: int = FAN_IN, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Globally ordered capture histories: part, place, then ``INDEX``; (part, place) is the order."""
    spark = manifest.sparkSession
    folder = folder or workspace(spark, "index")
    runs = manifest.collect()  # one row per archive, at most SAMPLES keys each
    keys = sorted(tuple(json.loads(s)) for r in runs for s in r.samples)
    parts = max(1, min(len(keys), -(-sum(r.n for r in runs) // range_captures)))
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)})
    bounds = [json.dumps(c) for c in cuts]
    lows, highs = [None, *bounds], [*bounds, None]
    segments = [[r.run for r in runs] for _ in lows]
    as_key = lambda s: tuple(json.loads(s)) if s else None
    task_schema = "part long, low string, high string, runs array<string>"

    def merged(row):
        part, low, high, sources = row
        return LoserTree([read_run(u, as_key(low), as_key(high)) for u in sources])

    def to_run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                run = RunWriter(attempt_name(folder, f"merge-{row[0]:06d}", ".run"))
                for entry in merged(row):
                    run.add(entry)
                run.close()
                yield pa.RecordBatch.from_pydict({"part": [row[0]], "run": [run.uri]})

    def to_rows(batches):
        names = ["part", "place", *(c.split()[0] for c in INDEX.split(", "))]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held = []
                for place, entry in enumerate(merged(row)):
                    held.append((row[0], place, *entry))
                    if len(held) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)

    while max(map(len, segments), default=0) > fan_in:
        tasks = [(p, lows[p], highs[p], s[i : i + fan_in]) for p, s in enumerate(segments) for i in range(0, len(s), fan_in)]
        done = written(spark.createDataFrame(tasks, task_schema).repartition(len(tasks)).mapInArrow(to_run, "part long, run string"), "merged")
        segments = [[] for _ in lows]
        for r in done.collect():  # one row per merge task
            segments[r.part].append(r.run)
    tasks = [(p, lows[p], highs[p], s) for p, s in enumerate(segments) if s]
    schema = "part long, place long, " + INDEX
    if not tasks:
        return spark.createDataFrame([], schema)
    return written(spark.createDataFrame(tasks, task_schema).repartition(len(tasks)).mapInArrow(to_rows, schema), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """Records found through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each archive is read by one task, in file order.  A response's digest is
    computed from what was read; a revisit states the length and digest of the
    payload it refers to and has none itself (``payload`` null).
    """

    def read(batches):
        at_path = file = None
        buffer, begin = b"", 0
        held, size = [], 0
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

        page_of = lambda urn: (lambda v: None if v == NULL_ID else v)(int(urn[10:-1]))
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != at_path:
                    fs, local = locate(path)
                    at_path, file, buffer, begin = path, fs.open_input_file(local), b"", 0
                if not begin <= offset <= offset + length <= begin + len(buffer):
                    buffer, begin = file.read_at(max(length, READ_BYTES), offset), offset
                headers, stated, body = parse_record(buffer[offset - begin : offset - begin + length])
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (len(body) != stated or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: payload differs from its digest")
                refers = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                held.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), stated, digest, kind, refers, body if kind == "response" else None))
                size += len(body)
                if size > OUT_BYTES or len(held) == 10_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    places = index.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset")
    return places.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records read back, merged index) of the archives written for ``pages``.

    Null html is an empty payload, a null url an empty key and no target header,
    a null page_id the smallest id.  Rows that repeat the smallest page_id of a
    payload are responses all.  Other columns are not read; an empty table gives
    empty results.
    """
    index = merge_index(write_archives(pages))
    return read_archives(index), index
