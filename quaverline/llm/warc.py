"""WARC files: a writer on Spark's text sink and a Python data source for reading.

Reading plans one partition per file, takes filters on the record type and on named header columns into the reader,
parses a record's header first and passes over the block of a record that no filter lets through.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .common import shared_dir

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_length long, payload binary"
#: Columns that are header fields, and so can be filtered before the block is read.
HEADER_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length"}
#: Bytes of payload in one Arrow batch.
BATCH_BYTES = 8 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def list_files(path: str) -> list[str]:
    """Data files under a path of any file system that Arrow knows; hidden files and markers don't count."""
    from pyarrow import fs

    system, root = _filesystem(path)
    scheme = path.split("://")[0] if "://" in path else "file"
    authority = path.split("://")[1].split("/")[0] if "://" in path and scheme not in ("file",) else ""
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [f"{scheme}://{authority}{n if n.startswith('/') or not authority else '/' + n}" for n in names]


class Plan(InputPartition):
    def __init__(self, file: str):
        self.file = file


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_FIELDS and type(f) in kinds:
                self.tests.append((name, kinds[type(f)], f.value))
            elif name in HEADER_FIELDS and isinstance(f, IsNotNull):
                self.tests.append((name, "has", None))
            else:
                yield f

    def partitions(self) -> list[Plan]:
        return [Plan(f) for f in list_files(self.path)]

    def wanted(self, record: dict) -> bool:
        for name, how, value in self.tests:
            own = record[name]
            if own is None:
                return False
            if how == "has":
                continue
            ok = own == value if how == "=" else own in value if how == "in" else own > value if how == ">" else own >= value if how == ">=" else own < value if how == "<" else own <= value
            if not ok:
                return False
        return True

    def read(self, partition: Plan) -> Iterator[pa.RecordBatch]:
        system, name = _filesystem(partition.file)
        schema = pa.schema([(n, pa.int64() if n == "content_length" else pa.binary() if n == "payload" else pa.string()) for n in (*HEADER_FIELDS, "payload")])
        rows: list[dict] = []
        held = 0
        with system.open_input_stream(name, compression=None) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 20)
            for record in records(stream, self.wanted, self.with_payload):
                rows.append(record)
                held += len(record["payload"] or b"")
                if held > BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option payload=false leaves every block undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise EOFError("a WARC block ends early")
        n -= got


def _head(stream) -> list[bytes] | None:
    """Lines up to the empty one; None at the end of the file. Blank lines before the version line don't count."""
    lines: list[bytes] = []
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if line:
            lines.append(line)
        elif lines:
            return lines
    if lines:
        raise EOFError("a WARC header ends early")
    return None


def _decoded(line: bytes) -> str:
    """Header fields are UTF-8; what isn't is taken as Latin-1, which any bytes are."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def records(stream, wanted=lambda record: True, with_payload: bool = True) -> Iterator[dict]:
    """Records of one file. ``wanted`` sees the header fields; a block that isn't wanted is passed over unread.

    A record without a version line or with another length than a number is a ValueError, one that ends early an EOFError.
    """
    while (lines := _head(stream)) is not None:
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields: dict[str, str] = {}
        for line in lines[1:]:
            key, _, value = _decoded(line).partition(":")
            fields[key.strip().lower()] = value.strip()
        if not (size := fields.get("content-length", "0")).isdecimal():
            raise ValueError(f"not a WARC content length: {size[:40]!r}")
        length = int(size)
        record: dict = {n: fields.get(h) for n, h in HEADER_FIELDS.items()} | {"content_length": length, "payload": None}
        if not wanted(record):
            _skip(stream, length)
            continue
        if with_payload and record["record_type"] != "revisit":
            block = stream.read(length)
            if len(block) < length:
                raise EOFError("a WARC block ends early")
            if fields.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            record["payload"] = block
        else:
            _skip(stream, length)
        yield record


def record_text(record_type: Column, record_id: Column, uri: Column, date: Column, digest: Column, refers_to: Column, payload: Column) -> Column:
    """One record as text, without the two line ends that follow it. Line ends in a URI are percent-encoded."""
    clean = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(F.lit(HTTP_HEAD), F.when(record_type == "revisit", F.lit("")).otherwise(payload))
    optional = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), record_type, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Date: "), date, F.lit(CRLF),
        optional("WARC-Target-URI", clean), optional("WARC-Payload-Digest", digest), optional("WARC-Refers-To", refers_to),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def urn_page(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """A record for each row of page_id, url and html.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest page_id is a response
    and the others are revisits without a payload. A null html is an empty payload; a row without a page_id is always a
    response. Digests meet in a partial aggregate first, so a payload that a third of all pages share needs no large
    group; the pages then join the digests that occur with several ids, a join that adaptive execution can split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    shared = (
        rows.filter((F.col("bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("original"), F.min("page_id").alias("least"))
        .filter("least < original")
        .drop("least")
    )
    known = rows.join(shared, ["digest", "bytes"], "left")
    kind = F.when(F.col("page_id") < F.col("original"), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(F.col("page_id") < F.col("original"), page_urn(F.col("original")))
    text = record_text(kind, page_urn(F.col("page_id")), F.col("url"), F.lit(date), F.concat(F.lit("sha1:"), F.col("digest")), refers, F.col("html"))
    known.select(text.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``; filters on their headers are pushed down.

    The filter that holds for all records makes Spark plan each query's filters anew: one without any would meet those of the last.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path).filter(F.col("content_length").isNotNull())


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """Writes ``pages`` as WARC files into the shared folder and describes each page from what is read back.

    page_id, payload_bytes, payload_digest (bare hexadecimal SHA-1, of the full payload; for a revisit that of the record
    it refers to), record_type, refers_to. Repeated rows give repeated rows; an empty table gives none.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_pages(pages, path, min_revisit_bytes)
    found = read(spark, path)
    own = found.filter(F.col("record_type") == "response").select(
        urn_page(F.col("record_id")).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    target = own.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").filter("refers_to is not null").dropDuplicates(["refers_to"])
    again = (
        read(spark, path, payload=False)
        .filter(F.col("record_type") == "revisit")
        .select(urn_page(F.col("record_id")).alias("page_id"), "record_type", urn_page(F.col("refers_to")).alias("refers_to"))
        .join(target, "refers_to", "left")
    )
    return own.unionByName(again.select(own.columns))
