"""Web archives: whole-file gzip streams, made into one member per record with an offset index beside each archive."""

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..session import scratch_path, staged
from .common import attach

#: Fixed values of the format.
VERSION, LINE = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAGE = "urn:x-page:"
#: Crawl time written to the records, unless another is given.
DATE = "1970-01-01T00:00:00Z"

#: Digests, of 32 letters, that may be broadcast.
MOST_BROADCAST_ROWS = 200_000

_CHUNK = 1 << 20
_INDEX = "archive string, offset long, length long, record_id string, record_type string, target string, payload_digest string"


def payload_digest(payload) -> Column:
    """The SHA-1 of a text's UTF-8 in base 32, without a prefix: five hex digits are four letters."""
    # The lambda's argument is computed once; written out, the digest would be taken for every letter.
    return F.transform(F.array(F.sha1(F.col(payload).cast("binary"))), _base32)[0]


def _base32(digits):
    letters = []
    for group in range(8):
        number = F.conv(F.substring(digits, 1 + 5 * group, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, *, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, record): a record for each page, response or revisit, without the two line ends behind it.

    Of pages with equal payloads of at least ``min_payload`` bytes the largest id is the response; the others refer to it. Payloads are not
    shuffled while the digests that occur twice pass the check for a broadcast; beyond it they are once, a hot one dealt to many tasks.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    ).select("*", F.octet_length("payload").cast("long").alias("size"), payload_digest("payload").alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
    twice = staged(groups.filter("copies > 1").drop("copies"), "payloads")
    if fits_broadcast(twice, MOST_BROADCAST_ROWS):
        placed = rows.join(F.broadcast(twice), "digest", "left")
    else:
        placed = attach(rows, groups, "digest", spread="page_id")
    revisit = (F.col("size") >= min_payload) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    named = lambda i: F.concat(F.lit(f"<{PAGE}"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat_ws(
        LINE,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), named(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named(F.col("response")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    )
    return placed.select("page_id", F.concat(head, F.lit(LINE + LINE), body).alias("record"))


def write_streams(written: DataFrame, folder: str) -> None:
    """Write records so that each partition is one file, one gzip stream from end to end: the text sink of Spark, with
    the two line ends that close a record as line separator, does so on any file system and commits whole files only."""
    written.select("record").write.option("compression", "gzip").option("lineSep", LINE + LINE).text(folder)


class _Inflated:
    """A gzip stream as bytes to read on; several members in a row are one stream."""

    def __init__(self, source):
        self.source, self.held, self.engine = source, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.engine.unused_data
        if self.engine.eof:
            data = data or self.source.read(_CHUNK)
            if not data:
                return False
            self.engine = zlib.decompressobj(31)
        else:
            data = self.source.read(_CHUNK)
            if not data:
                raise ValueError("the gzip stream ends early")
        self.held += self.engine.decompress(data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def chunks(self, size: int):
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.held[: min(size, _CHUNK)])
            del self.held[: len(out)]
            size -= len(out)
            if out:
                yield out


def fields(head: bytes) -> dict:
    """The named fields of a record's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split(LINE)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def normalise(source, sink) -> list[dict]:
    """Copy a gzip stream of records from ``source`` to ``sink``, each record as a member of its own; the offset index.

    The stream is inflated once and a record is held a megabyte at a time, so neither the file nor a record has to fit into memory.
    """
    stream, index, offset = _Inflated(source), [], 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        named = fields(head)
        engine, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        length += sink.write(engine.compress(head + b"\r\n\r\n"))
        for part in stream.chunks(int(named["content-length"])):
            length += sink.write(engine.compress(part))
        if b"".join(stream.chunks(4)) != b"\r\n\r\n":
            raise ValueError(f"no line ends behind {named.get('warc-record-id')}")
        length += sink.write(engine.compress(b"\r\n\r\n") + engine.flush())
        index.append(
            {
                "offset": offset,
                "length": length,
                "record_id": named.get("warc-record-id"),
                "record_type": named.get("warc-type"),
                "target": named.get("warc-target-uri"),
                "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:"),
            }
        )
        offset += length
    return index


class _Counted:
    def __init__(self, sink):
        self.sink = sink

    def write(self, data):
        self.sink.write(data)
        return len(data)


def _opened(path: str):
    """(file system, path in it) of a path or URI; Hadoop writes local URIs with one slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return pa.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _published(system, path, write):
    """Write under a name of this attempt, then rename: a repeated or doubled task never leaves half a file under the name."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as sink:
        out = write(_Counted(sink))
    system.move(attempt, path)
    return out


def normalise_archives(spark: SparkSession, streams: str, folder: str) -> DataFrame:
    """Normalise every whole-file stream in ``streams`` into ``folder``; (archive, records, bytes), one row per archive.

    Both folders are on storage that all executors reach. Tasks get paths, not contents. Beside ``x.warc.gz`` lies
    ``x.warc.gz.idx``, a line of JSON for each record: the offset and length of its member, id, type, target and digest.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(streams).select("path")
    target_system, root = _opened(folder)
    target_system.create_dir(root, recursive=True)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path)
                out, base = _opened(folder)
                name = f"{base}/{place.rsplit('/', 1)[1].split('.')[0]}.warc.gz"
                with system.open_input_stream(place, compression=None) as source:
                    index = _published(out, name, lambda sink, source=source: normalise(source, sink))
                lines = "".join(json.dumps({"archive": name} | row) + "\n" for row in index)
                _published(out, f"{name}.idx", lambda sink, lines=lines: sink.write(lines.encode()))
                yield pa.RecordBatch.from_pylist(
                    [{"archive": name, "records": len(index), "bytes": sum(r["length"] for r in index)}],
                    schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
                )

    # With a number given, the few rows are not put together into one task again.
    return paths.repartition(max(1, paths.count())).mapInArrow(run, "archive string, records long, bytes long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of all archives of a folder."""
    return spark.read.schema(_INDEX).option("pathGlobFilter", "*.idx").json(folder)


def read_records(index: DataFrame, folder: str, archives: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload): each record read through its place in the index.

    ``archives`` is the number of tasks. A response's payload must have the length and digest that its head names; a revisit has no payload, and both are taken from the head.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def read(batches):
        name, archive = None, None
        for batch in batches:
            rows, held = [], 0
            for wanted in batch.to_pylist():
                if wanted["archive"] != name:
                    name = wanted["archive"]
                    archive = _opened(folder)[0].open_input_file(name)
                archive.seek(wanted["offset"])
                rows.append(_parsed(zlib.decompress(archive.read(wanted["length"]), 31)))
                held += len(rows[-1]["payload"] or b"")
                if held > 16 * _CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ordered = index.select("archive", "offset", "length").repartition(archives, "archive").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _page(value):
    number = (value or "").strip("<>").removeprefix(PAGE)
    return int(number) if number.lstrip("-").isdigit() else None


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    named = fields(head)
    body = rest[: int(named["content-length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    digest, size, kind = named["warc-payload-digest"].removeprefix("sha1:"), int(named["x-payload-length"]), named["warc-type"]
    if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
        raise ValueError(f"payload of {named['warc-record-id']} is not what its head says")
    return {
        "page_id": _page(named["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(named.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def archived(pages: DataFrame, folder: str | None = None, *, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page, normalise the archives, read them back through the index; the columns of ``read_records``.

    Null html is an empty payload; null urls have no target field. Rows repeating an id and payload are records of their own, of the type that id has.
    Pages without an id can be responses only where no page with an id has the payload. ``folder`` (by default a new one in the shared
    scratch folder) gets ``streams`` and ``archives``. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_streams(records(pages, min_payload=min_payload, id_col=id_col, url_col=url_col, html_col=html_col), f"{folder}/streams")
    made = normalise_archives(spark, f"{folder}/streams", f"{folder}/archives").agg(F.sum("records").alias("records"), F.count("*").alias("archives")).first()
    if not made.records:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read_records(read_index(spark, f"{folder}/archives"), f"{folder}/archives", made.archives)
