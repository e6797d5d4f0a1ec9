"""WARC archives with an index: payloads once, revisits for repeats, byte-range reads.

Payload digests decide which record holds a payload: of equal ones that with the smallest id; its group shrinks to one row
per task before the shuffle. Payloads travel compressed and once, by row number, so no host or popular payload makes one
task large. Each task writes archives of bounded size, every record a gzip member of its own, and returns for each record
where it stands: archive, offset, length, URL, digest. An archive's name is new for each attempt, and only the written index
tells which archives count, so a lost executor leaves at most a file that nothing refers to.

Reading takes any selection of index rows, deals it by place to tasks of bounded size, joins neighbouring ranges to one read each and parses the
records. Archives are written and read through Arrow's file systems, which open local and cluster stores by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import emit_rows, map_rows
from hubmetrics.storage import materialize, scratch_path

#: An archive is closed beyond so many bytes; ranges closer than ``GAP`` are read at once, up to ``READ`` bytes.
ARCHIVE_BYTES = 64 << 20
GAP, READ = 64 << 10, 4 << 20
#: Bytes of records that one task reads.
TASK_BYTES = 32 << 20
LEVEL = 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(uri: str):
    """Arrow file system and path of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def told(value: str | None) -> str | None:
    """An id as ``record`` wrote it: escaped, so that any text is one line; without a line it is NULL."""
    return None if value is None else unquote(value)


def record(kind: str, page: str | None, url: str | None, payload: bytes, size: int, sha: str, refers: str | None) -> bytes:
    """One record as a gzip member. A revisit has no payload of its own but names digest and size of the full one."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {quote(page)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers is not None:
            lines.append(f"X-Refers-To: {quote(refers)}")
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of a record."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    return fields, rest[:size]


def write_warc(
    pages: DataFrame, folder: str | None = None, minimum: int = 0, id_column: str = "page_id", url_column: str = "url",
    payload_column: str = "html",
) -> DataFrame:
    """Write one record per row and return the index.

    Index: ``page_id (as text), row, url, digest, bytes, kind, refers_to, archive, offset, length``. NULL payloads are
    empty. Of payloads of ``minimum`` bytes or more that are equal the smallest id is the response and the others revisit
    it; among equal ids the first row is; NULL ids come last. An empty table gives an empty index. Other columns do not
    matter.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    source = pages.select(
        F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("row"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("_p"))

    def shrink():
        def run(payloads):
            raw = [p.encode("utf-8", "surrogatepass") for p in payloads]
            return {"digest": [digest(p) for p in raw], "bytes": [len(p) for p in raw], "packed": [zlib.compress(p, LEVEL) for p in raw]}

        return run

    stored = materialize(map_rows(source, ["_id", "row", "url"], ["_p"], [
        T.StructField("digest", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("packed", T.BinaryType()),
    ], shrink), "payloads")
    # A payload's bytes and digest together name it. Small ones stay apart by their row.
    name = F.when(F.col("bytes") >= minimum, F.col("digest")).otherwise(F.col("row").cast("string"))
    named = stored.select("_id", "row", name.alias("name"))
    first = named.groupBy("name").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("row").alias("row"))).alias("first"),
        F.count(F.lit(1)).alias("copies"))
    repeats = named.join(materialize(first.where("copies > 1").select("name", "first"), "repeats"), "name") \
        .where("row <> first.row").select("row", F.col("first.id").alias("refers_to"), F.lit(True).alias("again"))
    # The payload of a revisit is left behind before anything is shuffled only if the list can be broadcast.
    placed = stored.join(materialize(repeats, "revisits"), "row", "left").select(
        F.col("_id").alias("id"), F.col("_id").cast("string").alias("page_id"), "row", "url", "digest", "bytes", F.coalesce("again", F.lit(False)).alias("again"),
        F.col("refers_to").cast("string").alias("refers_to"),
        F.when(F.col("again"), F.lit(b"")).otherwise(F.col("packed")).alias("packed"))
    out = [T.StructField(n, t) for n, t in (
        ("page_id", T.StringType()), ("row", T.LongType()), ("url", T.StringType()), ("digest", T.StringType()),
        ("bytes", T.LongType()), ("kind", T.StringType()), ("refers_to", T.StringType()), ("archive", T.StringType()),
        ("offset", T.LongType()), ("length", T.LongType()))]

    def writer():
        state = {"file": None, "name": None, "at": 0}

        def close():
            if state["file"] is not None:
                state["file"].close()
                state["file"] = None

        def run(*columns):
            if not columns:
                close()
                return
            got = {f.name: [] for f in out}
            for page, row, url, sha, size, again, refers, packed in zip(*columns):
                if state["file"] is None or state["at"] >= ARCHIVE_BYTES:
                    close()
                    store, path = open_store(folder)
                    store.create_dir(path, recursive=True)
                    state["name"] = f"{uuid.uuid4().hex}.warc.gz"
                    state["file"], state["at"] = store.open_output_stream(f"{path}/{state['name']}", compression=None), 0
                kind = "revisit" if again else "response"
                member = record(kind, page, url, b"" if again else zlib.decompress(packed), size, sha, refers)
                state["file"].write(member)
                values = (page, row, url, sha, size, kind, refers, f"{folder}/{state['name']}", state["at"], len(member))
                for f, v in zip(out, values):
                    got[f.name].append(v)
                state["at"] += len(member)
            yield got

        return run

    return materialize(emit_rows(
        placed, ["page_id", "row", "url", "digest", "bytes", "again", "refers_to", "packed"], out, writer), "warc-index")


def ranges(offsets: list[int], lengths: list[int]) -> list[tuple[int, int, list[int]]]:
    """Reads ``(from, to, members)`` that cover the records: near neighbours share one."""
    out: list[tuple[int, int, list[int]]] = []
    for k in sorted(range(len(offsets)), key=lambda k: offsets[k]):
        start, end = offsets[k], offsets[k] + lengths[k]
        if out and start - out[-1][1] <= GAP and end - out[-1][0] <= READ:
            out[-1] = (out[-1][0], max(out[-1][1], end), [*out[-1][2], k])
        else:
            out.append((start, end, [k]))
    return out


def _read_tasks(index: DataFrame) -> int:
    """Tasks that read an index: one for every ``TASK_BYTES`` of records, and no fewer than archives or, at most, records."""
    spark = index.sparkSession
    got = index.agg(
        F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"), F.approx_count_distinct("archive").alias("archives")).first()
    wanted = max(-(-(got["bytes"] or 0) // TASK_BYTES), 2 * got["archives"], spark.sparkContext.defaultParallelism)
    return max(1, min(got["records"], wanted))


def read_warc(index: DataFrame) -> DataFrame:
    """The records that index rows point to: ``page_id, row, kind, url, payload, payload_digest, payload_bytes, refers_to``.

    ``payload`` is NULL for revisits. Digest and size are checked against the payload that is read. Rows are dealt by place,
    in a number of tasks that follows the archives' bytes and not the index's, so one archive may be read by several tasks. A task holds one range of ``READ`` bytes, or one longer
    record, at a time. An index row that is repeated is read as often; an empty index gives no rows.
    """
    dealt = index.repartitionByRange(_read_tasks(index), "archive", "offset").sortWithinPartitions("archive", "offset")
    out = [T.StructField(n, t) for n, t in (
        ("page_id", T.StringType()), ("row", T.LongType()), ("kind", T.StringType()), ("url", T.StringType()),
        ("payload", T.BinaryType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("refers_to", T.StringType()))]

    def make():
        def one(name, row, at, member):
            head, content = parse(member)
            kind, sha, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
            if kind == "response" and (len(content) != size or digest(content) != sha):
                raise ValueError(f"damaged record in {name} at {at}")
            return (told(head.get("X-Page-Id")), row, kind, head["WARC-Target-URI"],
                    content if kind == "response" else None, sha, size, told(head.get("X-Refers-To")))

        def run(archives=None, rows=None, offsets=None, lengths=None):
            for name in sorted(set(archives or [])):
                mine = [k for k, a in enumerate(archives) if a == name]
                store, path = open_store(name)
                with store.open_input_file(path) as file:
                    for start, end, members in ranges([offsets[k] for k in mine], [lengths[k] for k in mine]):
                        file.seek(start)
                        block = file.read(end - start)
                        found = [one(name, rows[k], offsets[k], block[offsets[k] - start: offsets[k] - start + lengths[k]])
                                 for k in (mine[m] for m in members)]
                        yield {f.name: list(column) for f, column in zip(out, zip(*found))}

        return run

    return emit_rows(dealt, ["archive", "row", "offset", "length"], out, make)
