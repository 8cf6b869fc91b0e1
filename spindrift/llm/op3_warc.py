"""WARC archives with an external index merge.

Writing: each task writes one archive of its captures, a gzip member for each record, and beside it a run: the index
lines of these captures, sorted by URL key, timestamp and page id, with the archive's offset and length of each record,
and the run's byte range for each of the merge's key ranges. Ranges are cut at quantiles of hashed samples of the whole
order (key, timestamp, id), so that a url with a third of all captures is cut as well.

Merging: a task for each key range opens its slice of every run and merges them with a loser tree, reading each slice
through a small buffer: memory grows with the number of runs in a merge, at most FAN_IN, not with their length. More
runs than that are merged in several rounds. The result is one globally ordered capture history.

Reading: the captures of the merged index are dealt to the archives, sorted by offset, and each record is read back and
parsed; lengths, digests, types and references come from the records.

Of the captures with equal payloads the one with the smallest page id is a response; others are revisits that refer to
it and carry the response's headers, with the payload's length and digest, but no payload. Pages are written once with
their digests and a number each; copies meet by digest, and what a page refers to is looked up where the page lies
(attach), so payloads are never shuffled, however many have copies. Files are written under a temporary name in the
shared folder and then moved; a task that runs again writes the same bytes under a name of its own, and only the names of
finished tasks are read on.

Defined results: a null html is an empty payload, a null url an empty target with the empty key; rows with equal page
id and payload are all responses if that id is the smallest; a null page id is never the smallest unless all are null,
and then all are responses; payloads under min_bytes are always responses; an empty table gives no rows; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Files, attach, cut, hot_join, name, numbered, scratch, slices, table

#: Runs that one merge reads at a time.
FAN_IN = 64
#: Captures in a key range, about, up to MOST_RANGES ranges: each run has a slice for each range, so that with more captures
#: ranges grow. A merge streams them, whatever their length. A sample of SAMPLED captures a range places the cuts.
RANGE_ROWS = 4_000
MOST_RANGES = 10_000
SAMPLED = 20
#: Archive bytes, about, that one task reads back.
READ_BYTES = 64 << 20
#: Bytes read at a time from a slice of a run.
BUFFER = 64 << 10
#: Fixed value: the time of page 0; page n is captured n seconds later.
EPOCH = 1_700_000_000


def url_key(url: str | None) -> str:
    """A sort-friendly key: host labels reversed, then path and query, A-Z lower-cased in the host; no scheme, port or fragment."""
    _, _, rest = (url or "").partition("://")
    rest = rest.split("#", 1)[0]
    cuts = [i for i in (rest.find("/"), rest.find("?")) if i >= 0]
    host, path = (rest[: min(cuts)], rest[min(cuts) :]) if cuts else (rest, "")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return f"{','.join(reversed(host.split('.')))}){path or '/'}" if host else ""


def record_id(page_id: int | None) -> str:
    """A UUID that holds the page id in its lower half."""
    top = 0x5D1F_7A3C_0B24_4E10 if page_id is not None else 0x5D1F_7A3C_0B24_4E11
    return f"<urn:uuid:{uuid.UUID(int=top << 64 | (page_id or 0) % (1 << 64))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record[len("<urn:uuid:") : -1]).int
    low = n % (1 << 64)
    return None if n >> 64 & 1 else low - (1 << 64) if low >> 63 else low


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str, stamp: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit with the response's headers alone."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """The fields and the payload of a gzip member that holds one record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is broken")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (payload_digest(payload) != digest or len(payload) != int(sent["Content-Length"])):
        raise ValueError("a payload differs from its digest")
    return {"type": fields["WARC-Type"], "page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "digest": digest, "bytes": int(sent["Content-Length"]), "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None}


def one_line(url: str) -> str:
    """A url as a header can hold it: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted iterators: each inner node keeps the loser of its match, so that the next smallest row costs one
    comparison a level on the path from the leaf that won last."""
    k = len(runs)
    if not k:
        return
    heads: list[tuple | None] = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    loser = [0] * k  # loser[0] is the winner
    best = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    winner = best[1] if k > 1 else 0
    while heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        node = (winner + k) >> 1
        while node:
            if beats(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node >>= 1


_SEP = "\t"


def _line(row: tuple) -> bytes:
    key, stamp, page, name, offset, length = row
    return _SEP.join((key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A"), stamp, "" if page is None else str(page), name, str(offset), str(length))).encode() + b"\n"


def _row(line: str) -> tuple:
    key, stamp, page, name, offset, length = line.split(_SEP)
    return key.replace("%0A", "\n").replace("%09", "\t").replace("%25", "%"), stamp, int(page) if page else None, name, int(offset), int(length)


def _order(row: tuple) -> tuple:
    """Key, timestamp, page id with null first; then the record's place, so that the order is total."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _read_slice(files: Files, name: str, start: int, length: int) -> Iterator[tuple]:
    """The lines of a byte range of a run, a buffer at a time, each with its sort key in front."""
    if not length:
        return
    with files.open(name) as f:
        f.seek(start)
        rest, left = b"", length
        while left:
            data = f.read(min(BUFFER, left))
            if not data:
                raise ValueError(f"{name} is shorter than its index says")
            left -= len(data)
            *lines, rest = (rest + data).split(b"\n")
            for x in lines:
                row = _row(x.decode())
                yield _order(row), row


RUN = T.StructType([T.StructField("run", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
CAPTURE = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("place", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("captured_at", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def with_references(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html with refers_to: the smallest page id with the payload, null for that page itself."""
    rows = pages.select(name("page_id").cast("long").alias("page_id"), F.coalesce(name("url"), F.lit("")).alias("url"), F.coalesce(name("html"), F.lit("")).alias("html"))
    held = cut(numbered(rows).withColumn("digest", F.unhex(F.sha1(F.encode("row.html", "utf-8")))).withColumn("size", F.octet_length("row.html")), "pages")
    known = held.filter(F.col("size") >= min_bytes).select("at", "digest", F.col("row.page_id").alias("page_id"))
    firsts = cut(known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1 and first_id is not null"), "firsts")
    # Payloads without copies meet nothing; what is left of the others is a number and an id.
    others = hot_join(known, firsts, ["digest"], "copies").filter("first_id is not null and not page_id <=> first_id")
    out = attach(held.select("at", "row"), others.select("at", F.col("first_id").alias("refers_to")))
    return out.select("row.*", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """Write archives and runs to `folder`; (the runs' slices, the number of key ranges)."""
    spark = pages.sparkSession
    n = pages.count()
    k = min(MOST_RANGES, max(1, -(-n // range_rows)))
    bounds: list[tuple] = []
    if k > 1:
        # A sample by hash, of expected size SAMPLED * k, only places the cuts; every row goes through the merge.
        drawn = pages.select("page_id", "url").filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, n // (SAMPLED * k)))) == 0)
        keys = sorted(_order((url_key(r[1]), _stamp(r[0]), r[0], "", 0)) for r in drawn.distinct().toLocalIterator())
        bounds = sorted({keys[len(keys) * i // k] for i in range(1, k)}) if keys else []
    held = spark.sparkContext.broadcast(bounds)
    schema = to_arrow_schema(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        files, name, index, size = Files(folder), uuid.uuid4().hex, [], 0

        def records() -> Iterator[bytes]:
            nonlocal size
            for b in slices(batches):
                for page, url, html, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    payload, stamp = html.encode(), _stamp(page)
                    raw = warc_record(page, one_line(url), stamp, payload, payload_digest(payload), refers)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(raw) + z.flush()
                    index.append((url_key(url), stamp, page, f"{name}.warc.gz", size, len(data)))
                    size += len(data)
                    yield data

        files.write(f"{name}.warc.gz", records())
        index.sort(key=_order)
        lines = list(map(_line, index))
        files.write(f"{name}.run", lines)
        spans: dict[int, list[int]] = {}
        at = 0
        for row, line in zip(index, lines, strict=True):
            span = spans.setdefault(bisect_right(held.value, _order(row)[:4] + ("", 0)), [at, 0])
            span[1] += len(line)
            at += len(line)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([f"{name}.run"] * len(spans), list(spans), [s[0] for s in spans.values()], [s[1] for s in spans.values()]), schema, strict=True)], schema=schema)

    return cut(with_references(pages, min_bytes).mapInArrow(run, RUN), "runs"), len(bounds) + 1


def _stamp(page_id: int | None) -> str:
    from datetime import UTC, datetime

    try:
        return datetime.fromtimestamp(EPOCH + (page_id or 0), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (OverflowError, OSError, ValueError):  # beyond what a calendar holds
        return datetime.fromtimestamp(EPOCH, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def merge_runs(runs: DataFrame, folder: str, n_ranges: int) -> DataFrame:
    """The captures in global order: by range, and by place inside a range."""
    schema = to_arrow_schema(CAPTURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        slots: list[tuple[int, str, int, int]] = []

        def merged(parts: list[tuple[str, int, int]]) -> Iterator[tuple]:
            """More slices than FAN_IN are first merged into longer runs, in files of their own."""
            while len(parts) > FAN_IN:
                longer = []
                for i in range(0, len(parts), FAN_IN):
                    name, size = f"{uuid.uuid4().hex}.merge", 0

                    def lines(group: list = parts[i : i + FAN_IN]) -> Iterator[bytes]:
                        nonlocal size
                        for _, row in loser_tree([_read_slice(files, *p) for p in group]):
                            x = _line(row)
                            size += len(x)
                            yield x

                    files.write(name, lines())
                    longer.append((name, 0, size))
                parts = longer
            return loser_tree([_read_slice(files, *p) for p in parts])

        def out(which: int, parts: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for place, (_, row) in enumerate(merged(parts)):
                rows.append((which, place, *row))
                if len(rows) == 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if slots and slots[0][0] != row[1]:
                    yield from out(slots[0][0], [(s[1], s[2], s[3]) for s in slots])
                    slots = []
                slots.append((row[1], row[0], row[2], row[3]))
        if slots:
            yield from out(slots[0][0], [(s[1], s[2], s[3]) for s in slots])

    return runs.repartition(n_ranges, "range").sortWithinPartitions("range", "run", "start").mapInArrow(run, CAPTURE)


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("captured_at", T.StringType()),
        T.StructField("history_range", T.IntegerType()),
        T.StructField("history_place", T.LongType()),
    ]
)


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """What the archives hold of each capture of a merged index (a table: it is read twice).

    Tasks are as many as the archives' bytes ask for: index rows are few bytes for what they stand for.
    """
    schema = to_arrow_schema(READ)
    tasks = -(-(captures.agg(F.sum("length")).first()[0] or 1) // READ_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, f = Files(folder), None, io.BytesIO()
        for b in batches:
            rows = []
            for which, place, key, stamp, page, archive, offset, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if archive != name:
                    f.close()
                    name, f = archive, files.open(archive)
                f.seek(offset)
                r = read_record(f.read(length))
                if r["page_id"] != page:
                    raise ValueError("the index and the archive differ")
                rows.append((r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"], key, stamp, which, place))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(schema)], schema=schema)
        f.close()

    return captures.repartition(max(tasks, 2 * captures.sparkSession.sparkContext.defaultParallelism), "archive", (F.col("offset") / (READ_BYTES // 16)).cast("long")).sortWithinPartitions("archive", "offset").mapInArrow(run, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives, runs and the merged index, read back."""
    folder = scratch(spark, "warc")
    runs, n = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    captures = cut(merge_runs(runs, folder, n), "captures")
    return read_archives(captures, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""
