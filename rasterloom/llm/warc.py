"""WARC archives of captures, with a capture index merged from locally sorted runs.

Writing: the first capture (smallest id) of each payload becomes a response, later ones revisits that refer to
it. Each writer task writes its own .warc.gz files (one gzip member for each record, rolled by size) under names that
hold a random part, and a sorted run of index entries. Only files named in the committed index count, so files of lost
or repeated tasks are ignored.

Index: entries are dealt out by range of (URL key, timestamp, id); each range merges its slices of the runs with a
k-way loser tree into global order.

Reading: archives are read whole as binary files, record by record; payload digests are computed anew from the payload
and checked against the header.

Defined results: a null payload is an empty one, and empty payloads count as equal. A null URL has the key ''. Rows with
equal id and payload are all responses if theirs is the smallest id; a null id is never the smallest unless all ids
of that payload are null, in which case all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, fresh_path, lean, stage

#: Compressed bytes after which a writer begins a new file.
ROLL_BYTES = 16 << 20
#: Bytes of an archive that are decompressed at once, and index entries of a range of the merge.
PIECE, RANGE_ENTRIES = 1 << 14, 500_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
ENTRY = "urlkey string, ts string, id long, file string, offset long, length long, digest string, kind string, refers_to long, payload_bytes long"
RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then the path and query, in lower case; the scheme and fragment go."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return url.strip().lower()
    return f"{host}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_time(id_: int | None) -> str:
    """A reproducible time for captures that come without one."""
    return (EPOCH + timedelta(seconds=abs(id_ or 0) % (1 << 33))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(url: str | None, ts: str, id_: int | None, payload: bytes, digest: str, refers_to: int | None, name: str, place: str) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit carries no payload.

    place (file and offset) tells records apart. A response is named by its id and payload, so that revisits can refer to it;
    only rows that repeat both share a name.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{id_}/{digest}' if refers_to is None and id_ is not None else f'{name}/{place}')}>",
        f"WARC-Date: {ts}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if id_ is not None:
        head.append(f"X-Capture-ID: {id_}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        head.append("Content-Type: application/http; msgtype=response")
        body = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{refers_to}/{digest}')}>", f"X-Refers-To-Capture: {refers_to}", "Content-Type: application/http; msgtype=response"]
        body = http + b"\r\n"
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write captures as WARC files below path; returns the (staged) index entries, each task's in key order."""
    spark = captures.sparkSession
    bounded_batches(spark)
    rows = captures.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # hot payloads: counted before the shuffle, and their side of the join can be split by AQE
    first = rows.groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = rows.join(first.hint("merge"), "sha1", "left").select("id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    name = path.rstrip("/").rpartition("/")[2]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        run, out, at, file = [], None, 0, ""
        for batch in batches:
            for id_, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None or at >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                digest, ts = digest32(payload), capture_time(id_)
                data = _gzip(record(url, ts, id_, payload, digest, refers, name, f"{file}/{at}"))
                out.write(data)
                run.append((url_key(url), ts, id_, file, at, len(data), digest, "response" if refers is None else "revisit", refers, len(payload)))
                at += len(data)
            if len(run) >= 100_000:  # a run of bounded size
                yield _entries(sorted(run, key=_order))
                run = []
        if out is not None:
            out.close()
        if run:
            yield _entries(sorted(run, key=_order))

    return stage(marked.mapInArrow(lean(write), ENTRY), "runs")


def _order(entry: tuple) -> tuple:
    """Key of an index entry: URL key, time, id (null first), place."""
    return (entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4])


def _entries(run: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run), kinds)] if run else [pa.array([], t) for t in kinds], names)


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so the next winner costs log2(k) comparisons."""

    END = (1,)

    def __init__(self, runs: list[list], key) -> None:
        self.runs, self.key = runs, key
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.pos = [0] * self.k
        self.head = [self._at(i) for i in range(self.k)]
        self.lost = [0] * self.k
        winners = list(range(self.k))
        node = self.k
        while len(winners) > 1:
            node //= 2
            up = []
            for i in range(0, len(winners), 2):
                a, b = winners[i], winners[i + 1]
                if self.head[b] < self.head[a]:
                    a, b = b, a
                self.lost[node + i // 2] = b
                up.append(a)
            winners = up
        self.best = winners[0]

    def _at(self, i: int) -> tuple:
        return (0, self.key(self.runs[i][self.pos[i]]), i) if i < len(self.runs) and self.pos[i] < len(self.runs[i]) else self.END

    def __iter__(self) -> Iterator:
        while self.head[self.best] != self.END:
            w = self.best
            yield self.runs[w][self.pos[w]]
            self.pos[w] += 1
            self.head[w] = self._at(w)
            node = (w + self.k) // 2
            while node >= 1:
                if self.head[self.lost[node]] < self.head[w]:
                    self.lost[node], w = w, self.lost[node]
                node //= 2
            self.best = w


def merge_runs(runs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """All index entries in global order: range ``seq_range`` by range, ``seq`` within it.

    A range has about RANGE_ENTRIES entries at most; entries with equal URL keys are told apart by time, id and place,
    so a hot URL or host spans as many ranges as it needs.
    """
    n = n_ranges or max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(n, "urlkey", "ts", F.col("id").asc_nulls_first(), "file", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[str, list] = {}
        for batch in batches:
            for e in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                runs.setdefault(e[3], []).append(e)  # a file's entries are a run
        for run in runs.values():
            run.sort(key=_order)  # slices arrive in runs; this is linear then
        merged = list(LoserTree(list(runs.values()), _order))
        part = TaskContext.get().partitionId()
        for i in range(0, len(merged), 10_000):
            b = _entries(merged[i : i + 10_000])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(i, i + n, dtype=np.int64))], [*b.schema.names, "seq_range", "seq"])

    return dealt.mapInArrow(lean(merge), ENTRY + ", seq_range int, seq long")


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, HTTP body) of each record of a .warc.gz."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, raw, end = zlib.decompressobj(31), [], at
        while not z.eof and end < len(data):  # in pieces, as what a record leaves over is copied
            raw.append(z.decompress(view[end : end + PIECE]))
            end += PIECE
        if not z.eof:
            return
        raw, end = b"".join(raw), min(end, len(data)) - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        yield at, fields, block.partition(b"\r\n\r\n")[2]
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below path, one row for each; a file that a lost task left short ends at its last whole record."""
    bounded_batches(spark)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                for at, f, body in parse_archive(content.as_py()):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(f["X-Payload-Length"])
                    if kind == "response" and (digest32(body) != digest or len(body) != size):
                        raise ValueError(f"payload digest differs in {file} at {at}")
                    as_int = lambda k: int(f[k]) if k in f else None
                    out.append((as_int("X-Capture-ID"), size, digest, kind, as_int("X-Refers-To-Capture"), file, at))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in RECORD.split(", ")])

    return whole.mapInArrow(lean(read), RECORD)


def archive_round_trip(captures: DataFrame, path: str | None = None, **cols: str) -> DataFrame:
    """Write captures, merge their index and read all back: the records with their place in the capture history.

    The index decides which records count; one that it names but no archive holds is an error.
    """
    spark = captures.sparkSession
    path = path or fresh_path(spark, "warc")
    runs = write_archives(captures, path, **cols)
    if runs.isEmpty():
        return spark.createDataFrame([], RECORD + ", urlkey string, seq_range int, seq long")
    index = merge_runs(runs).select("file", "offset", "urlkey", "seq_range", "seq")
    there = read_archives(spark, path).withColumn("there", F.lit(True))
    found = index.join(there, ["file", "offset"], "left").where(F.coalesce("there", F.raise_error(F.concat(F.lit("no record in "), "file")).cast("boolean")))
    return found.drop("there")
