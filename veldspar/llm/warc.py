"""WARC archives compressed record by record with Zstandard and a shared dictionary.

A ``.warc.zst`` file begins with a skippable frame (magic number 0x184D2A5D) that holds
the dictionary, itself compressed or not; each record after it is a frame of its own.
The reader is a Spark data source: each file is a partition, read as a stream, one
frame at a time, and every record is checked before it becomes a row.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import column_values, table_path

MAGIC_DICTIONARY, MAGIC_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
SUFFIX = ".warc.zst"
MANDATORY = ("warc-record-id", "warc-type", "warc-date", "content-length")
#: Bytes that a record may have once decompressed (a row of Spark can't hold more), bytes read from a file at once, bytes of dictionary.
MAX_RECORD, READ, DICTIONARY = (1 << 31) - (1 << 20), 1 << 20, 64 << 10
#: Pieces of pages that the dictionary is trained on, and characters of a piece.
TRAINING_PIECES, PIECE_CHARS = 400, 1 << 18
DATE = "2024-01-01T00:00:00Z"

SCHEMA = "file string, position long, warc_type string, record_id string, target_uri string, headers map<string,string>, payload binary, error string"

# --- records ------------------------------------------------------------------


def record(kind: str, record_id: str, payload: bytes, **headers: str) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **headers, "Content-Length": str(len(payload))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes | None, str | None]:
    """(headers by lower-case name, payload, what is wrong or None)."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, None, "headers don't end"
    first, *lines = data[:end].split(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        return {}, None, "no WARC version line"
    headers: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or key.split() != [key]:
            return headers, None, "a malformed header"
        name = key.decode("utf-8", "replace").lower()
        headers[name] = value.strip().decode("utf-8", "replace")
    missing = [m for m in MANDATORY if m not in headers]
    if missing:
        return headers, None, f"no {missing[0]}"
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()):
        return headers, None, "content-length is no number"
    rest = data[end + 4 :]
    if len(rest) != int(length) + 4:
        return headers, None, f"content-length is {int(length)}, {len(rest) - 4} bytes are there"
    if rest[-4:] != b"\r\n\r\n":
        return headers, None, "the record doesn't end in two line breaks"
    payload = rest[:-4]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        return headers, None, "the block digest differs"
    return headers, payload, None


# --- files ----------------------------------------------------------------------


#: Schemes that Spark and Arrow know by different names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path there. Schemes: file, hdfs and viewfs (with the
    Hadoop native library on the executors), s3 (s3a), gs and abfs."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def dictionary_frame(dictionary: bytes, compressed: bool = True) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return struct.pack("<II", MAGIC_DICTIONARY, len(body)) + body


def frames(stream, read: int = READ, limit: int = MAX_RECORD) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(position, decompressed frame, what is wrong) of the frames of an archive.

    A record of more than ``limit`` bytes is read to its end, but not kept, and those after
    it follow. What can't be decompressed ends the file, as the next frame's place isn't
    known.
    """
    buffer, position, ended = b"", 0, False

    def fill(n: int) -> bool:
        nonlocal buffer, ended
        while len(buffer) < n and not ended:
            got = stream.read(max(read, n - len(buffer)))
            ended = not got
            buffer += got
        return len(buffer) >= n

    dictionary = None
    while fill(1):
        if not fill(8):
            yield position, None, "the file ends within a frame's head"
            return
        magic, size = struct.unpack("<II", buffer[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not fill(8 + size):
                yield position, None, "the file ends within a skippable frame"
                return
            if position == 0 and magic == MAGIC_DICTIONARY:
                body = buffer[8 : 8 + size]
                try:
                    if body[:4] == MAGIC_FRAME:
                        whole = zstandard.ZstdDecompressor().decompressobj()
                        body = whole.decompress(body)
                        if not whole.eof:
                            raise zstandard.ZstdError("its frame is cut off")
                    dictionary = zstandard.ZstdCompressionDict(body)
                except zstandard.ZstdError as problem:
                    yield 0, None, f"the dictionary can't be read: {problem}"
                    return
            buffer, position = buffer[8 + size :], position + 8 + size
            continue
        unit = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        out, total, used = [], 0, 0
        try:
            while True:
                piece = unit.decompress(buffer)
                used += len(buffer)
                total += len(piece)
                if total <= limit:
                    out.append(piece)
                else:
                    out.clear()
                if unit.eof:
                    break
                buffer = stream.read(read)
                if not buffer:
                    yield position, None, "the file ends within a frame"
                    return
        except zstandard.ZstdError as problem:
            yield position, None, f"a frame can't be decompressed: {problem}"
            return
        buffer = unit.unused_data
        used -= len(buffer)
        if total > limit:
            yield position, None, f"a record of more than {limit} bytes"
        else:
            yield position, b"".join(out), None
        position += used


def rows_of(uri: str) -> Iterator[tuple]:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        for position, data, error in frames(stream):
            headers, payload, wrong = parse(data) if data is not None else ({}, None, error)
            yield uri, position, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers, payload, wrong


class _File(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        fs, path = filesystem(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [_File(self.path)]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(SUFFIX)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):
            return
        rows, size = [], 0
        for row in rows_of(partition.uri):
            rows.append(row)
            size += len(row[6] or b"") + 500
            if size >= 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string())
    cols = list(zip(*rows))
    cols[5] = [list(h.items()) for h in cols[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


class WarcZst(DataSource):
    """spark.read.format("warc_zst").load(path): a file, or a folder of *.warc.zst.

    A row for each record. Of one that fails a check or is too long for a row, ``error`` says
    what is wrong and payload is null; its row stays, with such headers as were read. After a frame that
    can't be decompressed a file has no further rows. An empty file has none.
    """

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcZst)
    return spark.read.format("warc_zst").load(path)


# --- writing ----------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of pages; empty if they are too few or too small to learn from."""
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) < 1024:  # the library's trainer crashes on a handful of bytes
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _writer(path: str, shared):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        trained = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=trained) if trained else zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId()
        name, attempt = f"{folder}/part-{part:06d}{SUFFIX}", f"{folder}/_part-{part:06d}-{uuid.uuid4().hex}"
        count = 0
        with fs.open_output_stream(attempt, compression=None) as out:
            if trained:
                out.write(dictionary_frame(shared.value))
            for batch in batches:
                for page, url, html in zip(*column_values(batch, "page_id", "url", "html")):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    extra = {"X-Page-Id": "" if page is None else str(page), "X-Null": ",".join(k for k, v in (("url", url), ("html", html)) if v is None)}
                    if url is not None:
                        extra["WARC-Target-URI"] = plain = url.strip().replace("\r", "%0D").replace("\n", "%0A")
                        if plain != url:  # a header can't have it as it is
                            extra["X-Url"] = json.dumps(url)
                    extra["WARC-Block-Digest"] = "sha256:" + hashlib.sha256(payload).hexdigest()
                    out.write(packer.compress(record("resource", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{count}')}>", payload, **extra)))
                    count += 1
        try:
            fs.move(attempt, name)  # a task that is run again replaces the file as a whole
        except OSError:
            if not fs.get_file_info(name).is_file:
                raise
            fs.delete_file(attempt)  # another attempt has written the same
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["records"])

    return write


def write_archives(pages: DataFrame, path: str, training_pieces: int = TRAINING_PIECES, piece_chars: int = PIECE_CHARS) -> int:
    """Pages as resource records, an archive for each partition; how many there are.

    The dictionary is trained on a bounded sample, which decides how small archives are and
    nothing else: pages are seen as pieces of ``piece_chars`` characters, and those with the
    ``training_pieces`` least hashes are taken, wherever in a page they are.
    """
    spark = pages.sparkSession
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.length("html") - 1) / piece_chars).cast("int")))
    hashed = columns.where("html <> ''").select("page_id", "url", "html", pieces.alias("piece")).withColumn("h", F.xxhash64("page_id", "url", "piece"))
    # the hashes first, so that what tasks send to the driver doesn't grow with their number
    least = hashed.select("h").distinct().orderBy("h").limit(training_pieces).agg(F.max("h")).first()[0]
    text = F.substring(F.col("html"), F.col("piece") * piece_chars + 1, F.lit(piece_chars))
    chosen = hashed.where(F.col("h") <= least).select("h", text.alias("html")).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if least is not None else []
    dictionary = train_dictionary([r.html.encode("utf-8", "surrogatepass") for r in chosen])
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    return columns.mapInArrow(_writer(path, spark.sparkContext.broadcast(dictionary)), "records long").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages written to archives in the shared folder and read from there again:
    (page_id, url, html, error).

    Null pages, ids and urls stay null, repeated rows stay repeated, an empty table gives
    no rows. A url comes back as it was: where a header can't have it (white space at its
    ends, line breaks), the header has it trimmed, with %0D and %0A, and one of its own has
    the whole. Pages may be as long as a string of Spark can be.
    """
    spark = pages.sparkSession
    path = path or table_path(spark, "archives")
    write_archives(pages, path)
    absent = F.col("headers")["x-null"]
    whole = F.get(F.from_json(F.concat(F.lit("["), F.col("headers")["x-url"], F.lit("]")), "array<string>"), F.lit(0))
    return read_archives(spark, path).select(
        F.expr("try_cast(nullif(headers['x-page-id'], '') AS bigint)").alias("page_id"),
        F.when(~F.contains(absent, F.lit("url")), F.coalesce(whole, F.col("target_uri"), F.lit(""))).alias("url"),
        F.when(~F.contains(absent, F.lit("html")), F.col("payload").cast("string")).alias("html"),
        "error",
    )


PAGES_SQL = "SELECT page_id, url, html, NULL::VARCHAR AS error FROM pages"
