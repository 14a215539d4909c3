"""WARC archives in Zstandard: written and read one frame a record.

An archive begins with a skippable frame that holds the dictionary of all its
frames.  Every record is one frame, so an archive can be read from any record's
offset.  The reader takes the dictionary from the skippable frame, decodes one
frame a record, and validates header lines, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import keyed_join, shared_path, staged

#: Fixed values of the formats: magic number of the dictionary's skippable frame, of a Zstandard frame, and of a dictionary.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this many bytes on are stored once.
REVISIT_LEAST = 1000
#: The dictionary is trained on at most so many payloads of the first so many characters each; it bears on size alone.
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 64 << 10
LEVEL = 3
#: Compressed bytes after which a task begins its next archive.
ROLL = 1 << 30
#: Bytes read at once.
CHUNK = 1 << 20


class WarcError(ValueError):
    """An archive or record that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        """The body of the HTTP message in the block."""
        head, sep, body = self.block.partition(b"\r\n\r\n")
        if not sep:
            raise WarcError("the HTTP header has no end")
        return body


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def labelled(digest_hex: str) -> str:
    """The digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def pack(headers: dict[str, str], block: bytes) -> bytes:
    """A record's bytes; Content-Length is added."""
    for k, v in headers.items():
        if "\r" in v or "\n" in v or ":" in k:
            raise WarcError(f"header {k} cannot be written")
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Record:
    """The record in one frame's bytes, validated."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise WarcError("the record does not begin with a version and headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.decode()] = value.strip().decode()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["Content-Length"].isdigit():
        raise WarcError("bad Content-Length")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block {len(rest) - 4}")
    return Record(headers, rest[:n])


def opening(dictionary: bytes) -> bytes:
    """The skippable frame at an archive's head."""
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


class Reader:
    """Records of an archive from a stream; memory holds the dictionary and one record."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""
        head = self._take(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic != SKIPPABLE:
            raise WarcError("the archive does not begin with a dictionary")
        held = self._take(size)
        if len(held) != size:
            raise WarcError("the dictionary is cut off")
        if held[:4] == FRAME:
            held = zstandard.ZstdDecompressor().decompress(held)
        if size and held[:4] != DICTIONARY:
            raise WarcError("the first frame holds no dictionary")
        self.decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if size else zstandard.ZstdDecompressor()

    def _take(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.stream.read(CHUNK)):
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def __iter__(self) -> Iterator[Record]:
        while True:
            chunk = self.rest or self.stream.read(CHUNK)
            if not chunk:
                return
            frame, out = self.decoder.decompressobj(), []
            try:
                while True:
                    out.append(frame.decompress(chunk))
                    if frame.eof:
                        self.rest = frame.unused_data
                        break
                    if not (chunk := self.stream.read(CHUNK)):
                        raise WarcError("the last frame is cut off")
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            yield parse(b"".join(out))


def train(payloads: list[bytes]) -> bytes:
    """A dictionary for payloads like these; empty where there is too little to learn from."""
    samples = [p for p in payloads if p]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:  # too uniform
        return b""


def http_block(payload: bytes, length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n" + payload


def one_line(url: str | None) -> str:
    """A header value: controls and spaces in percent form; null is ``about:blank``."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url) if url is not None else "about:blank"


def _payload() -> dict[str, Column]:
    """What tells payloads apart: SHA-1, two xxHash values and the length of the bytes, so a collision of SHA-1 alone merges nothing."""
    html = F.coalesce("html", F.lit(""))
    return {"digest": F.sha1(F.encode(html, "UTF-8")), "check": F.xxhash64(html), "check2": F.xxhash64(F.lit("payload"), html), "n_bytes": F.octet_length(html).cast("bigint")}


def decided(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """``key, page_id, digest, check, check2, n_bytes, first`` once for each page_id and payload: first is the largest page_id of those with the same payload of ``least`` bytes or more where it is another page's, else null."""
    same = ["digest", "check", "check2", "n_bytes"]
    light = staged(pages.select("page_id", *(v.alias(k) for k, v in _payload().items())).distinct(), "digests")
    shared = light.where(F.col("n_bytes") >= least).groupBy(*same).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(*same, "last")
    return keyed_join(light, staged(shared, "shared"), same, "left").select("page_id", *same, F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("first"))


def pack_page(page: str | None, url: str | None, html: str | None, digest: str, n_bytes: int, seen: str | None) -> bytes:
    """A page's record: a response, or a revisit of the page ``seen``."""
    headers = {
        "WARC-Type": "response" if seen is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": one_line(url),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": labelled(digest),
    }
    if page is not None:
        headers["X-Page-Id"] = quote(page)
    if seen is not None:
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(seen, digest), "X-Refers-To-Page-Id": quote(seen)}
    payload = (html or "").encode() if seen is None else b""
    return pack(headers, http_block(payload, n_bytes))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages(page_id, url, html)`` as a record below ``folder``; returns the written ``path, records``.

    A task begins a new archive after ROLL bytes, so archives stay of a size that
    one reader takes, however large the partitions.  Attempts of a task write to
    names of their own, and only the attempt whose rows are kept is read, so a
    lost executor leaves at most unread files.
    """
    spark = pages.sparkSession
    sample = pages.where("html is not null").select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).limit(SAMPLES).collect()
    dictionary = train([r["h"].encode() for r in sample])
    same = list(_payload())
    decisions = decided(pages).withColumnsRenamed({"page_id": "_id", **{c: f"_{c}" for c in same}})
    own = pages.select("page_id", "url", "html", *(v.alias(k) for k, v in _payload().items()))
    on = own["page_id"].eqNullSafe(decisions["_id"])
    for c in same:
        on = on & (own[c] == decisions[f"_{c}"])
    rows = own.join(decisions, on).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "n_bytes", F.col("first").cast("string").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        done: list[tuple[str, int]] = []
        packed = (pack_page(*values) for batch in batches for values in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True))
        for first in packed:
            path, count, size = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
            with fs.open_output_stream(path, compression=None) as out:
                out.write(opening(dictionary))
                for record in chain((first,), packed):
                    frame = encoder.compress(record)
                    out.write(frame)
                    count, size = count + 1, size + len(frame)
                    if size >= ROLL:
                        break
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    written = rows.mapInArrow(write, "path string, records bigint")
    return staged(written, "manifest")


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """The records of ``archives(path, records)``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits).

    The payload of a response is held against its digest and its HTTP length; a
    missing record is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with fs.open_input_stream(path, compression=None) as stream:
                    yield from _table(Reader(stream), path, records)

    def _table(reader: Iterable[Record], path: str, records: int) -> Iterator[pa.RecordBatch]:
        rows, held, seen = [], 0, 0
        for record in reader:
            h, payload = record.headers, record.payload()
            length = int(record.block[: len(record.block) - len(payload)].split(b"Content-Length: ")[1].split(b"\r\n")[0])
            digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            response = h["WARC-Type"] == "response"
            if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                raise WarcError(f"{path}: the payload of {h['WARC-Record-ID']} does not fit its digest or length")
            if not response and (h["WARC-Type"] != "revisit" or payload or "WARC-Refers-To" not in h):
                raise WarcError(f"{path}: {h['WARC-Record-ID']} is neither response nor revisit")
            as_id = lambda k: unquote(h[k]) if k in h else None  # noqa: B023, E731
            rows.append((as_id("X-Page-Id"), length, digest, h["WARC-Type"], as_id("X-Refers-To-Page-Id"), h["WARC-Target-URI"], payload if response else None))
            held, seen = held + len(payload), seen + 1
            if held > 8 << 20 or len(rows) >= 5000:
                yield _batch(rows)
                rows, held = [], 0
        if seen != records:
            raise WarcError(f"{path} has {seen} records, not {records}")
        if rows:
            yield _batch(rows)

    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    wanted = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary"
    n = max(1, archives.count())
    # paths from one partition are dealt in turn, one to a task, where a hash would leave tasks empty and others with several
    found = archives.coalesce(1).repartition(n).mapInArrow(read, wanted)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = shared_path(spark, "warc")
    return read_archives(write_archives(pages, folder), folder, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""
