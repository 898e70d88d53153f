"""WARC archives compressed with Zstandard and a shared dictionary (operator 2).

An archive begins with a skippable frame that holds the dictionary; one frame for each
record follows. Tasks write archives of bounded size straight to the shared folder, under
names that no other attempt uses, and tell which they finished; only those are read. The
reader streams a file, decodes a frame at a time and validates headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path
from .common import bitmap, thinned, written

#: Fixed values of the formats: frame and dictionary magic numbers, the revisit profile.
DICTIONARY_FRAME, SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages that the dictionary is trained on at most, bytes of each, and of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
#: Compressed bytes after which a task begins another archive; bytes read at a time.
ARCHIVE, CHUNK = 64 << 20, 1 << 16

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, fault string"


def marked(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload binary, digest string, refers_to long`` for each row of ``pages``:
    of equal payloads of at least ``least`` bytes, all but those of the largest id refer to it."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    told = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    keeper = told.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = written(told.join(keeper, "digest").where("page_id < refers_to").distinct(), "revisits")
    # payloads that surely are no revisits stay where they are
    some = bitmap(revisits.select("page_id").distinct(), "page_id")
    moved = thinned(rows, "page_id", some).join(revisits, ["page_id", "digest"], "left")
    still = thinned(rows, "page_id", some, inside=False).withColumn("refers_to", F.lit(None).cast("long"))
    return moved.select(still.columns).union(still)


def train_dictionary(rows: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads, those of smallest hash: trained on them,
    or where they are too few for that, their own beginnings; empty if there are none."""
    import zstandard

    told = rows.where(F.octet_length("payload") >= 64).select("page_id", "digest", F.xxhash64("page_id", "digest").alias("h"))
    picked = F.broadcast(told.orderBy("h", "page_id").limit(SAMPLE).distinct())  # SAMPLE rows of a few bytes
    got = rows.join(picked, ["page_id", "digest"]).select("h", F.substring("payload", 1, SAMPLE_BYTES).alias("p")).dropDuplicates(["h"]).orderBy("h")
    samples = [bytes(r["p"]) for r in got.collect()]  # SAMPLE x SAMPLE_BYTES at most
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s[: DICTIONARY_BYTES // len(samples)] for s in samples)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response or revisit record; both hold the HTTP head, a response the payload too."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of :func:`marked` to archives in ``folder``, a URI that all executors
    reach, and returns ``path string, records long``, a written table."""
    dictionary = rows.sparkSession.sparkContext.broadcast(train_dictionary(rows))  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow.fs import FileSystem

        d = dictionary.value
        z = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    if d:
                        out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(d).to_bytes(4, "little") + d)
                frame = z.compress(record(*(x.as_py() for x in row), date))
                out.write(frame)
                size, n = size + len(frame), n + 1
                if size >= ARCHIVE:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return written(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"), "archives")


class Broken(ValueError):
    """A record, or a file, that isn't as it should be."""


def frames(stream) -> Iterator[bytes]:
    """The contents of each frame of a stream, decoded with the dictionary of its first,
    skippable frame if there is one. Raises :class:`Broken` at what can't be decoded."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    rest = b""

    def fill(n: int) -> bytes:
        parts, have = [rest], len(rest)
        while have < n and (more := stream.read(max(CHUNK, n - have))):
            parts.append(more)
            have += len(more)
        return b"".join(parts)

    first = True
    while rest := fill(8):
        magic = int.from_bytes(rest[:4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(rest[4:8], "little")
            rest = fill(8 + size)
            if len(rest) < 8 + size:
                raise Broken("a skippable frame is cut off")
            body, rest = rest[8 : 8 + size], rest[8 + size :]
            if first and magic == DICTIONARY_FRAME:
                body = zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME else body
                kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
                z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
            first = False
            continue
        first = False
        if rest[:4] != FRAME:
            raise Broken("not a frame")
        one, out = z.decompressobj(), []
        try:
            while not one.eof:
                if not rest and not (rest := stream.read(CHUNK)):
                    raise Broken("a frame is cut off")
                out.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
        except zstandard.ZstdError as e:
            raise Broken(f"a frame can't be decoded: {e}") from e
        yield b"".join(out)


def parse(raw: bytes) -> tuple:
    """The columns of RECORD but ``fault``. Raises :class:`Broken` for a record whose version,
    fields, lengths, ending or digest aren't right."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", version):
        raise Broken("no WARC version")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Broken("a header line isn't a field")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Broken(f"{name} is missing")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Broken("the length isn't that of the block")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not gap or not length:
        raise Broken("no HTTP head")
    kind, size = fields["warc-type"], int(length[1])
    try:
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    except (KeyError, ValueError) as e:
        raise Broken("no payload digest") from e
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise Broken("the payload isn't as long as told, or not of its digest")
    if kind == "revisit" and payload:
        raise Broken("a revisit with a payload")
    ids = []
    for name in ("warc-record-id", "warc-refers-to"):
        m = re.fullmatch(r"<urn:page:(-?\d*)>", fields.get(name, "<urn:page:>"))
        if not m:
            raise Broken(f"{name} isn't a page")
        ids.append(int(m[1]) if m[1] else None)
    if kind not in ("response", "revisit") or (kind == "revisit") != (ids[1] is not None):
        raise Broken("not a response, nor a revisit that refers to one")
    return ids[0], fields.get("warc-target-uri"), kind, ids[1], size, digest, payload


def read(archives: DataFrame) -> DataFrame:
    """RECORD for each record of the files that ``archives`` lists (``path string``).

    A record that isn't valid, or the place where a file can't be decoded further, gives a
    row with nothing but ``fault``; so does a file that has fewer or more records than
    ``records`` tells, where ``archives`` has that column. Empty archives give no rows.
    """
    counted = "records" in archives.columns
    rows = archives.select("path", F.col("records").cast("long") if counted else F.lit(None).cast("long").alias("records"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = rows.sparkSession.createDataFrame([], RECORD).schema
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def records(path: str, expected: int | None) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, name = FileSystem.from_uri(path)
        n = 0
        with fs.open_input_stream(name, compression=None) as stream:
            try:
                for raw in frames(stream):
                    n += 1
                    try:
                        yield (*parse(raw), None)
                    except Broken as e:
                        yield (None,) * 7 + (str(e),)
            except Broken as e:
                yield (None,) * 7 + (str(e),)
        if expected is not None and n != expected:
            yield (None,) * 7 + (f"{n} records, not {expected}",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r in records(path, expected):
                    held.append(r)
                    size += len(r[6] or b"") + 200
                    if size >= 4 << 20:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    spread = rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path"))
    return spread.mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """RECORD for each row of ``pages``, written to archives in the shared folder and read back.

    A null html is an empty payload; payloads below ``least`` bytes are all responses. Rows
    that share id and payload are the same kind; rows without an id are responses. An empty
    table gives an empty one.
    """
    spark: SparkSession = pages.sparkSession
    return read(write(marked(pages, least, id_col, url_col, html_col), new_path(spark, "warc")))
