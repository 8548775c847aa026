"""WARC archives of pages: written, read back, and indexed in capture order.

Method: external index merge.

1. A payload's SHA-1 and size come from the text columns. Where pages share a
   payload of at least 1,000 bytes, the one with the largest page_id is stored
   as a response and the others as revisits of it; that choice is a partial
   aggregation and a join in which a payload of more pages than SALT_ROWS is
   dealt over as many parts as it needs, so that one payload in a third of all
   pages is no single task.
2. Each task writes its records, gzip member by member, to archive files in the
   shared folder, under a name that no other attempt uses. Only files that a
   finished task reports exist for what follows.
3. The archives are read back record by record, each by a task of its own.
   Digests of stored payloads are computed anew and must equal the header's. An
   archive's captures are sorted by URL key, time and page RUN_ROWS at a time;
   each such run is written out in that order, numbered within it.
4. Runs are cut by ranges of that key, balanced within a URL too. A range's part
   of a run is put back in the order of its numbers, not sorted by key again, and
   each range merges its parts with a loser tree. The ranges in order are the
   capture history of every URL.

Defined results: a null html is an empty payload. A null url is archived
without a target and sorts first. Rows with equal page_id and payload are alike:
all with the largest page_id are responses. A null page_id is never referred
to; if all copies of a payload have none, all are responses. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import count, islice, pairwise
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import exchange as X
from wordloom.storage import settle, shared_dir

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
#: Pages of one payload that are joined with its response together, or a share of all pages by which at most so many payloads are dealt over parts.
SALT_ROWS = 50_000
MOST_DEALT = 100_000
#: Captures of a run, and captures merged by one task.
RUN_ROWS = 20_000
RANGE_ROWS = 50_000
BLOCK_ROWS = 4096

_RUN = "url_key string, captured string, page_id long, archive string, record_offset long, record_type string, payload_digest string, payload_bytes long, refers_to long, run long, number long"
_NAMES = [c.split()[0] for c in _RUN.split(", ")]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A sortable key: the host's labels from the right, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return key.lower()


def _header_text(value: str) -> str:
    """A URL fit for a header line: control characters, spaces and non-ASCII bytes percent-encoded."""
    return re.sub(r"[^\x21-\x7E]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header alone."""
    when = datetime(2000, 1, 1, tzinfo=UTC) + timedelta(seconds=abs(page_id or 0) % 10**9)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = http + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, its payload's digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(name, ""))) else None
    return {"url_key": url_key(fields.get("WARC-Target-URI")), "captured": fields["WARC-Date"], "page_id": number("WARC-Record-ID"), "record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": number("WARC-Refers-To")}


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        out, name, size = None, None, 0
        done: list[str] = []
        for batch in batches:
            for page_id, url, html, digest, n, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "n", "refers_to")), strict=True):
                if out is None:
                    name, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(name, compression=None)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id, url, (html or "").encode(), digest, n, refers_to)) + squeeze.flush()
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append(name)
                    out = None
        if out is not None:
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})

    return run


def records(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member of an archive, one in memory at a time."""
    at, left = 0, b""
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not left:
                left = stream.read(1 << 20)
                if not left:
                    raise ValueError("the archive ends within a record")
            parts.append(member.decompress(left))
            used += len(left) - len(member.unused_data)
            left = member.unused_data
        yield at, b"".join(parts)
        at += used


def _runs(folder: str, run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with system.open_input_stream(archive, compression=None) as stream:
                    read = ({**parse(raw), "archive": archive, "record_offset": at} for at, raw in records(stream))
                    for n in count():
                        rows = sorted(islice(read, run_rows), key=_order)
                        if not rows:
                            break
                        for at in range(0, len(rows), BLOCK_ROWS):
                            yield _batch([r | {"run": n, "number": at + i} for i, r in enumerate(rows[at : at + BLOCK_ROWS])])

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in _NAMES}, schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _RUN.split(", ")])


def _order(row: dict) -> tuple:
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["record_offset"]


def loser_tree(runs: list[Iterable], key) -> Iterator:
    """The items of sorted runs in order. Each inner node keeps the loser of its match, so that an item costs one match a level."""
    if not runs:
        return
    width = 1 << max(0, (len(runs) - 1).bit_length())
    sources = [iter(r) for r in runs] + [iter(())] * (width - len(runs))
    last = object()
    heads = [next(r, last) for r in sources]
    keys = [last if h is last else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        return keys[a] is not last and (keys[b] is last or (keys[a], a) < (keys[b], b))

    winners, losers = list(range(width)), [0] * width
    for level in count(1):
        if width >> level == 0:
            break
        nodes = width >> level
        following = []
        for i in range(nodes):
            a, b = winners[2 * i], winners[2 * i + 1]
            won, lost = (a, b) if beats(a, b) else (b, a)
            losers[nodes + i] = lost
            following.append(won)
        winners = following
    best = winners[0]
    while keys[best] is not last:
        yield heads[best]
        heads[best] = next(sources[best], last)
        keys[best] = last if heads[best] is last else key(heads[best])
        node = (width + best) >> 1
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node >>= 1


def _rows(table: pa.Table) -> Iterator[dict]:
    """A run's part, a block of rows in memory at a time."""
    for batch in table.to_batches(BLOCK_ROWS):
        yield from batch.to_pylist()


def _rows(table: pa.Table) -> Iterator[dict]:
    """A run's part, a block of rows in memory at a time."""
    for batch in table.to_batches(BLOCK_ROWS):
        yield from batch.to_pylist()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index: the runs' parts in it, one after the other and each in its order, merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    archive, run = table.column("archive").combine_chunks().dictionary_encode().indices.to_numpy(), table.column("run").to_numpy()
    changes = np.flatnonzero((np.diff(archive) != 0) | (np.diff(run) != 0)) + 1
    starts = [0, *changes.tolist(), len(run)]
    parts = [_rows(table.slice(a, b - a)) for a, b in pairwise(starts)]
    some: list[dict] = []
    for row in loser_tree(parts, _order):
        some.append(row)
        if len(some) == BLOCK_ROWS:
            yield _batch(some)
            some = []
    if some:
        yield _batch(some)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, n, refers_to): refers_to is null where a record is a response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    copies = settle(pages.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1 and head is not null"))
    limit = max(SALT_ROWS, copies.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // MOST_DEALT)
    dealt = copies.where(F.col("copies") > limit).select("digest", F.ceil(F.col("copies") / limit).alias("parts"))
    # at most MOST_DEALT rows, as their copies sum to all pages at most
    salted = pages.join(F.broadcast(dealt), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / limit) - 1))
    heads = copies.select("digest", "head", F.when(F.col("copies") > limit, F.lit(True)).alias("many"), "copies")
    heads = heads.where("many").select("digest", "head", salts.alias("salt")).union(heads.where("many is null").select("digest", "head", F.lit(0).cast("long")))
    joined = salted.join(heads, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", "n", F.when(F.col("page_id").isNull() | (F.col("head") != F.col("page_id")), F.col("head")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(archive): the WARC files written to the folder for pages(page_id, url, html)."""
    return settle(with_revisits(pages).mapInArrow(_write(folder, ARCHIVE_BYTES), "archive string"))


def capture_index(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in global order of (url_key, captured, page_id)."""
    n = max(1, archives.count())  # a number of partitions that is not joined up again: one archive is a task's work
    runs = settle(archives.repartitionByRange(n, "archive").mapInArrow(_runs(folder, RUN_ROWS), _RUN))
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "record_offset")
    return dealt.sortWithinPartitions("archive", "run", "number").mapInArrow(_merge, _RUN)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to WARC archives in the shared folder, read them back and return their index, one row a page."""
    X.small_batches(pages.sparkSession)
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = capture_index(write_archives(pages, folder), folder)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "record_offset")


SQL = """
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), heads AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM heads
"""
