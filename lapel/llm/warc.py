"""WARC archives: a deterministic sharded writer, and a reader of what its manifest names.

Pages are cut into shards by ranges of their id, from a histogram of payload bytes that depends on the rows alone, not
on their layout. A task sorts a shard, builds every record anew (headers, lengths, digests, gzip member) and rolls to
the next file by compressed size. Files are written under temporary names; their list is a Spark output, so only files
of successful attempts are in it. Renaming to the final names can be repeated; the manifest is written last, and readers
see the files that it names. The shared folder is reached through pyarrow's file systems (local or mounted, S3, GCS, HDFS).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.llm.common import materialise, partitions_of

_FILE = "shard long, part int, temporary string, name string, bytes long, records long, sha256 string"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, intact boolean"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


# ---- which records, and where ----


def summaries(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """What decides a record's type and place: id, digest of the whole payload, bytes. Null payload counts as empty."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("content"), F.octet_length(payload).cast("long").alias("bytes"))


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, content, refers_to) of the pages whose payload a page with a larger id has too."""
    large = rows.filter(F.col("bytes") >= least_bytes)
    last = large.groupBy("content").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return large.join(last, "content").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "content", "refers_to").distinct()


def shard_bounds(rows: DataFrame, shard_bytes: int, bins: int = 1024) -> np.ndarray:
    """First ids of all shards but the first. Ranges that hold too much are cut again until they are small or one id."""
    ends = rows.agg(F.min("page_id"), F.max("page_id")).first()
    if ends[0] is None:
        return np.zeros(0, np.int64)
    low, high = ends
    edges = _cut(low, high + 1, bins)
    for _ in range(8):
        sizes = _histogram(rows, edges)
        widths = np.append(edges[1:], np.int64(min(high + 1, 2**63 - 1))) - edges
        heavy = np.flatnonzero((sizes > shard_bytes // 2) & (widths > 1))
        if not len(heavy):
            break
        edges = np.unique(np.concatenate([edges, *(_cut(int(edges[k]), int(edges[k] + widths[k]), 64) for k in heavy)]))
    bounds, held = [], 0
    for edge, size in zip(edges.tolist(), sizes.tolist(), strict=True):
        if held and held + size > shard_bytes:
            bounds.append(edge)
            held = 0
        held += size
    return np.array(bounds, np.int64)


def _cut(low: int, high: int, parts: int) -> np.ndarray:
    parts = max(1, min(parts, high - low))
    return np.array([low + (high - low) * k // parts for k in range(parts)], np.int64)


def _histogram(rows: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Payload bytes from each edge up to the next; a task hands on sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges))
        for batch in batches:
            total += np.bincount(_place(batch.column("page_id"), edges[1:]), batch.column("bytes").to_numpy(), len(edges))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["bin", "bytes"])

    found = rows.mapInArrow(run, "bin long, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes")).toPandas()
    out = np.zeros(len(edges), np.int64)
    out[found["bin"].to_numpy(np.int64)] = found["bytes"].to_numpy(np.int64)
    return out


def _place(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The shard of each id; a null id is in the first."""
    return np.searchsorted(bounds, ids.fill_null(-(2**63)).to_numpy(), "right")


# ---- records ----


def _record_id(page_id: int | None, content: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{content}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, content: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One record as a gzip member; equal arguments give equal bytes."""
    block = _HTTP.format(len(payload)).encode() + (b"" if is_revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, content)}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"X-Payload-Bytes: {len(payload)}"]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, content)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


_URL_SAFE = "%/:=&?~#+!$,;'@()*[]"


def _writer(folder: str, roll_bytes: int, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        done: list[tuple] = []
        shard, part, out, size, count, sums, temporary = None, 0, None, 0, 0, None, ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, part, temporary, f"pages-{shard:08d}-{part:05d}.warc.gz", size, count, sums.hexdigest()))
                out = None

        marks: tuple = ()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "page_id", "content", "kind", "url", "payload", "refers_to"))
            for s, page_id, content, kind, url, payload, refers_to in zip(*columns, strict=True):
                if kind == 0:  # a mark comes before the rows that it makes revisits
                    marks = (page_id, content, refers_to)
                    continue
                if s != shard or size >= roll_bytes:
                    close()
                    shard, part = s, part + 1 if s == shard else 0
                    temporary = f"_temporary/{shard:08d}-{part:05d}-{uuid.uuid4().hex}"
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    out, size, count, sums = store.open_output_stream(f"{root}/{temporary}", compression=None), 0, 0, hashlib.sha256()
                again = marks[:2] == (page_id, content)
                member = record(page_id, url, payload, content, marks[2] if again else None, again, date)
                out.write(member)
                sums.update(member)
                size, count = size + len(member), count + 1
        close()
        if done:
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], ["shard", "part", "temporary", "name", "bytes", "records", "sha256"])

    return run


def _renamer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                if store.get_file_info(f"{root}/{temporary}").type != pafs.FileType.NotFound:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} is not the file that was written")
            yield batch

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 4 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages to a new folder and returns the manifest: one row per file.

    Of equal payloads of `least_revisit_bytes` or more, the page with the largest id is the response and the others
    revisit it; rows that repeat that id with that payload are responses too. Null payload counts as empty, a null url
    has no header, a null id sorts first and is never referred to. An empty table gives an empty manifest. Other
    columns are not read. The folder must not hold a manifest yet.
    """
    spark = pages.sparkSession
    rows = materialise(summaries(pages, id_col, payload_col), "pages")
    bounds = shard_bounds(rows, shard_bytes)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column("page_id"), bounds)), *batch.columns], ["shard", *batch.schema.names])

    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    whole = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("content"), F.lit(1).alias("kind"), F.col(url_col).alias("url"), payload.alias("payload"), F.lit(None).cast("long").alias("refers_to"))
    marks = revisits(rows, least_revisit_bytes).select("page_id", "content", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    placed = whole.unionAll(marks).mapInArrow(sharded, "shard long, page_id long, content string, kind int, url string, payload binary, refers_to long")
    order = ["shard", "page_id", "content", "kind", "url"]
    n = max(partitions_of(spark), 1)
    dealt = placed.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions(*order)  # no two share a task before all have one
    dealt.mapInArrow(_writer(folder, roll_bytes, date), _FILE).write.parquet(f"{folder}/_written")
    written = spark.read.schema(_FILE).parquet(f"{folder}/_written")
    written.mapInArrow(_renamer(folder), _FILE).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_FILE).parquet(f"{folder}/_manifest")


# ---- reading ----


def _members(stream) -> Iterator[bytes]:
    """Gzip members one at a time."""
    left = b""
    while True:
        data = left or stream.read(1 << 16)
        if not data:
            return
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            out.append(unzip.decompress(data))
            if not unzip.eof and not (data := stream.read(1 << 16)):
                raise EOFError("a record is cut off")
        left = unzip.unused_data
        yield b"".join(out)


def parsed(member: bytes) -> tuple:
    """A record's row, as in _RECORD; intact says whether lengths and digests agree with the bytes."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    names = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(names["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest, size = names["WARC-Type"], names["WARC-Payload-Digest"], int(names["X-Payload-Bytes"])
    intact = version == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and names["WARC-Block-Digest"] == f"sha1:{hashlib.sha1(block).hexdigest()}"
    if kind == "response":
        intact = intact and digest == f"sha1:{hashlib.sha1(payload).hexdigest()}" and size == len(payload)
    number = {k: int(names[k]) if k in names else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    return number["X-Page-Id"], names.get("WARC-Target-URI"), kind, size, digest.removeprefix("sha1:"), number["X-Refers-To-Page-Id"], payload if kind == "response" else None, intact


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest names; a file is one task's work at most."""
    fields = [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]]) for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        rows.append(parsed(member))
                        size += len(member)
                        if size > 8 << 20:
                            yield _batch(rows, fields)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, fields)

    files = spark.read.schema(_FILE).parquet(f"{folder}/_manifest").select("name")
    return files.repartition(partitions_of(spark)).mapInArrow(run, _RECORD)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def oracle() -> str:
    return """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        g AS (SELECT page_id, octet_length(payload) AS n, payload, max(page_id) OVER (PARTITION BY payload) AS last_id FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM g
    """
