"""WARC archives of captured pages, and their capture index as an external merge of sorted runs."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

#: Payloads of fewer bytes are never written as revisits.
MIN_BYTES = 0
#: Payload bytes of an archive, about, and captures of a range that is merged in one task, about.
ARCHIVE = 32 << 20
RANGE = 100_000
#: Runs that are merged at once; more go through several passes.
FAN_IN = 64
#: Tasks that read archives back, at most; with more archives, a task reads several.
READERS = 50_000
#: Captures carry no time: page n counts as fetched n seconds after this.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = 0x5EED


def record_id(page_id: int | None) -> str:
    """A version 8 UUID whose free low bits hold the 64-bit id; another leading part for null."""
    bits = (page_id or 0) & ((1 << 64) - 1)
    top = (_NAMESPACE + (page_id is None)) << 80
    return f"<urn:uuid:{uuid.UUID(int=top | 8 << 76 | (bits >> 62) << 64 | 2 << 62 | bits & ((1 << 62) - 1))}>"


def page_of(record: str) -> int | None:
    x = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if x >> 80 != _NAMESPACE:
        return None
    bits = (x >> 64 & 3) << 62 | x & ((1 << 62) - 1)
    return bits - (1 << 64) if bits >> 63 else bits


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-case: example.com/a -> com,example)/a. Scheme,
    a leading www, user, default port, fragment and a closing slash don't count; null is empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    at = "" if port in (None, 80, 443) else f":{port}"
    rest = (parts.path.rstrip("/") or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{at}){rest}".lower()


def _header_safe(value: str) -> str:
    """Control characters and blanks of a URL percent-encoded: they would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One gzip member with a response record, or a revisit of the record of page `original`: its HTTP
    head with the full payload's length, and no body."""
    date = EPOCH + timedelta(seconds=max(0, min(page_id or 0, 1 << 36)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        *([f"WARC-Target-URI: {_header_safe(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Refers-To: {record_id(original)}", f"WARC-Profile: {REVISIT_PROFILE}"] if original is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, block) of each gzip member of an archive, read member by
    member."""
    offset, rest = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            rest = rest or stream.read(1 << 18)
            if not rest:
                if used:
                    raise EOFError("the archive ends within a record")
                return
            parts.append(unpacker.decompress(rest))
            used += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        headers = {k.lower(): v for k, v in headers.items()}
        yield offset, used, headers, body[: int(headers["content-length"])]
        offset += used


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, most: int):
    """Rows (page_id, url, html, original) -> archives in the shared folder; (archive) for each. A file is
    written under a name of its own attempt, so a repeated task leaves at most an archive that no row
    names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        names, out, size = [], None, 0
        for batch in batches:
            for page_id, url, html, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original")), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    store.create_dir(at, recursive=True)
                    out, size = store.open_output_stream(f"{at}/{names[-1]}", compression=None), 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.write(record(page_id, url, payload, original))
                size += len(payload) + 512
                if size >= most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.record_batch({"archive": pa.array(names, pa.string())})

    return run


_CAPTURE = "urlkey string, timestamp string, page_id long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder: str):
    """Archives -> their captures, as runs sorted by URL key, time and page."""
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in _CAPTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows = []
                with store.open_input_stream(f"{at}/{archive}", compression=None) as stream:
                    for offset, length, headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{archive} at {offset}: the payload is not what its headers say")
                        time = headers["warc-date"].translate({ord(c): None for c in "-:TZ"})
                        original = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((url_key(headers.get("warc-target-uri")), time, page_of(headers["warc-record-id"]), archive, offset, length, size, digest, kind, original))
                rows.sort(key=_order)
                for i in range(0, len(rows), 10_000):
                    cols = zip(*rows[i : i + 10_000], strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _order(row: tuple) -> tuple:
    """URL key, time, page (null first), archive, place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class LoserTree:
    """Merges sorted iterables: each inner node of a tournament keeps the run that lost there, so that the
    winner's next item is only played against the losers on its way up."""

    def __init__(self, runs: Iterable[Iterable], key: Callable = lambda x: x):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.items = [None] * self.k
        self.keys: list = [None] * self.k
        self.open = [True] * self.k
        for i in range(self.k):
            self._next(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, first=True)

    def _next(self, i: int) -> None:
        for item in self.runs[i]:
            self.items[i], self.keys[i] = item, self.key(item)
            return
        self.open[i] = False

    def _before(self, a: int, b: int) -> bool:
        if not self.open[a] or not self.open[b]:
            return self.open[a]
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int, first: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            if first and self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.open[i := self.losers[0]]:
            yield self.items[i]
            self._next(i)
            self._play(i)


def merge_runs(runs: list[Iterable], key: Callable, fan_in: int = FAN_IN) -> Iterator:
    """All runs in one order; more than fan_in by trees of trees, each of which reads its runs as they are asked for."""
    while len(runs) > fan_in:
        runs = [LoserTree(runs[i : i + fan_in], key) for i in range(0, len(runs), fan_in)]
    return iter(LoserTree(runs, key))


def _rows(parts: list[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple]:
    """The rows of a run, made from its columns a few at a time."""
    for part in parts:
        for i in range(0, part.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in part.slice(i, at_once).columns), strict=True)


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range, its slices of the runs one after another -> its captures in order. The slices are held as
    columns and read by the loser trees a few rows at a time."""
    runs: list[list[pa.RecordBatch]] = []
    now, schema = None, None
    for batch in batches:
        schema = batch.schema
        names = batch.column("archive").to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()
        for i, j in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if i < j:
                if names[i] != now:
                    now = names[i]
                    runs.append([])
                runs[-1].append(batch.slice(i, j - i))
    if schema is None:
        return
    merged = merge_runs([_rows(r) for r in runs], _order)
    while rows := list(islice(merged, 10_000)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def archive_pages(pages: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES, archive: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row (page_id, url, html) to WARC archives in the shared folder, and reads
    the archives back -> captures, each archive's in the order of URL key, time and page.

    Of records with equal payloads of min_bytes or more, that with the smallest page_id is the response
    and the others revisit it. Null html is an empty payload, a null url leaves its header out, a null
    page_id never is the smallest (without any other, all are responses), and repeated rows of the
    smallest page are all responses."""
    keyed = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    keyed = scratch.keep(keyed.filter(F.col("size") >= min_bytes), "digests")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null")
    again = keyed.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", "original").distinct()
    again = scratch.keep(again, "again").withColumnsRenamed({"page_id": "again_id", "digest": "again_digest"})
    own = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html").join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (own == F.col("again_digest")), "left")
    written = rows.select("page_id", "url", "html", "original").mapInArrow(_writer(scratch.path("warc"), archive), "archive string")
    written = scratch.keep(written, "archives")
    tasks = min(READERS, max(1, written.count()))  # so many, as a row is a file of many bytes: its number is not left to their sizes
    return written.repartition(tasks).mapInArrow(_reader(scratch.path("warc")), _CAPTURE)


def capture_index(captures: DataFrame, scratch: Scratch, per_range: int = RANGE) -> DataFrame:
    """Sorted capture runs, one for each archive -> the captures in global order of URL key, time and page,
    with capture: the number of the capture in its URL's history, from 0.

    The runs are written to the shared folder first; key ranges of bounded size, cut within a URL's
    history where it is long, then fetch their slices of all runs (in transit blocks are mixed, so that each
    task puts its slices in order again), and each range is merged by a loser tree over its runs, by a
    tree of trees if they are many. Of equal keys, times and pages the order is that of archive and place.
    Without captures the index is empty."""
    runs = scratch.keep(captures, "runs")
    n = runs.count()
    ranges = max(1, -(-n // per_range))
    order = ["urlkey", "timestamp", "page_id", "archive", "offset"]
    cut = runs.repartitionByRange(ranges, *order).sortWithinPartitions("archive", *order[:3], "offset")
    merged = scratch.keep(cut.mapInArrow(_merger, _CAPTURE).withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "index")
    sizes = merged.groupBy("urlkey", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ahead = Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("urlkey").alias("k"), F.col("range").alias("r"), F.col("first"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    joined = merged.join(sizes, (F.col("urlkey") == F.col("k")) & (F.col("range") == F.col("r")))
    return joined.withColumn("capture", F.col("before") + F.col("place") - F.col("first")).drop("k", "r", "first", "before", "range")
