"""Zstandard WARC archives: one frame per record behind a leading dictionary frame (operator 1)."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import durable, fits, query, scratch_folder, ship_package, table
from .storage import reading, writing

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are never replaced by a revisit.
SMALLEST_REVISIT = 1000
#: The dictionary is trained on this much of the head of each archive.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 2 << 20, 32 << 10
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Payloads with copies are broadcast up to this number of groups and joined by a shuffle beyond it.
BROADCAST_GROUPS = 100_000
DATE = "2000-01-01T00:00:00Z"
_CHUNK = 1 << 16


class WarcError(ValueError):
    pass


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit keeps the HTTP head, which names the full length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", DATE)]
    if page_id is not None:
        head.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|^{}\\\"<>`")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one decoded frame; anything that is not exactly one sound record is an error.

    All record types are read. A payload is what follows the HTTP head of a response, revisit or request,
    and the whole block of other records. A stated digest of a known kind, in hex or base 32, has to fit it;
    a revisit's digest is that of the payload it leaves out.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8")).split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line!r}")
        fields.setdefault(name.lower(), value.strip())
    kind = fields.get("warc-type")
    size = fields.get("content-length", "")
    if not kind or not size.isdigit():
        raise WarcError("record type or length is missing")
    if len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block is not as long as its header says")
    payload, stated, chunked = rest[:-4], None, False
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, gap, payload = payload.partition(b"\r\n\r\n")
        said = [(k.lower(), v.strip()) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])]
        length = [v for k, v in said if k == b"content-length" and v.isdigit()]
        stated = int(length[-1]) if length else None
        chunked = any(k == b"transfer-encoding" and b"chunked" in v.lower() for k, v in said)
        if not gap and kind in ("response", "request"):
            raise WarcError("the HTTP head does not end")
    digest = fields.get("warc-payload-digest")
    revisit = kind == "revisit"
    if revisit:
        if "/revisit/" not in fields.get("warc-profile", "") or (payload and fields["warc-profile"] == REVISIT_PROFILE):
            raise WarcError("a revisit of an equal payload names its profile and has no payload")
        if digest is None and fields["warc-profile"] == REVISIT_PROFILE:
            raise WarcError("a revisit of an equal payload has its digest")
    else:
        if stated is not None and kind == "response" and not chunked and len(payload) != stated:
            raise WarcError("the payload differs from its length")
        if digest is not None and not (_fits(digest, payload) or (chunked and _fits(digest, _unchunked(payload)))):
            raise WarcError("the payload differs from its digest")
    return {"page_id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
            "payload_bytes": stated if revisit else len(payload), "payload_digest": _hex(digest) if digest else None, "record_type": kind,
            "refers_to": _number(fields.get("warc-refers-to")), "record_id": fields.get("warc-record-id"),
            "refers_to_id": fields.get("warc-refers-to"), "payload": None if revisit else payload}


def _hex(digest: str) -> str:
    """The bare digest in lower-case hex, whichever of the two usual spellings it has."""
    kind, _, value = digest.rpartition(":")
    size = {"sha1": 20, "sha-1": 20, "md5": 16, "sha256": 32, "sha-256": 32, "sha512": 64, "sha-512": 64}.get(kind.lower())
    if size is not None and len(value) != 2 * size:
        try:
            return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except binascii.Error as error:
            raise WarcError(f"bad digest {digest!r}") from error
    return value.lower()


def _fits(digest: str, payload: bytes) -> bool:
    kind = digest.rpartition(":")[0].lower().replace("-", "")
    return kind not in ("sha1", "md5", "sha256", "sha512") or hashlib.new(kind, payload).hexdigest() == _hex(digest)


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size) or int(size, 16) == 0:
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def _number(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", value or "")
    return int(found[1]) if found else None


def dictionary_of(samples: list[bytes]):
    """A trained dictionary, or None where the samples are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(out, records: Iterator[bytes], limit: int = ARCHIVE_BYTES) -> int:
    """Write records until ``limit`` compressed bytes are reached; the number written."""
    head, size = [], 0
    for record in records:
        head.append(record)
        size += len(record)
        if len(head) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    dictionary = dictionary_of(head)
    if dictionary is not None:
        frame = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(frame).to_bytes(4, "little") + frame)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    written = count = 0
    for source in (head, records):
        for record in source:
            frame = packer.compress(record)
            out.write(frame)
            count += 1
            written += len(frame)
            if written >= limit and source is records:
                return count
    return count


def read_archive(file) -> Iterator[bytes]:
    """Decoded records, one frame each; only one record and one chunk are held at a time."""
    start = file.read(8)
    dictionary = None
    left = start
    if len(start) == 8 and int.from_bytes(start[:4], "little") == DICTIONARY_FRAME:
        size = int.from_bytes(start[4:], "little")
        raw = file.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut short")
        if raw[:4] == ZSTD_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
        left = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        left = left or file.read(_CHUNK)
        if not left:
            return
        frame, out = unpacker.decompressobj(), []
        while not frame.eof:
            if not left:
                left = file.read(_CHUNK)
                if not left:
                    raise WarcError("the last frame is cut short")
            try:
                out.append(frame.decompress(left))
            except zstandard.ZstdError as error:
                raise WarcError(f"bad frame: {error}") from error
            left = b""
        left = frame.unused_data
        yield b"".join(out)


def _archives_written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()

        def records():
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
                for row in range(batch.num_rows):
                    page, url, html, digest, refers = (c[row].as_py() for c in columns)
                    yield record_bytes(page, url, (html or "").encode(), digest, refers)

        stream, number = records(), 0
        ahead = next(stream, None)
        while ahead is not None:
            uri = f"{folder}/part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.warc.zst"
            with writing(uri) as out:
                count = write_archive(out, _chained(ahead, stream))
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count])], names=["path", "records"])
            ahead, number = next(stream, None), number + 1

    return run


def _chained(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)``; ``path, records`` of each archive.

    Of equal payloads of at least ``SMALLEST_REVISIT`` bytes the row with the largest page_id is stored
    and the others revisit it; rows that repeat that page_id are stored too, and if no row of a group
    has a page_id all are. A null html is an empty payload, a null url or page_id is left out of the record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    groups = durable(rows.where(F.col("bytes") >= SMALLEST_REVISIT).groupBy("digest", "bytes")
                     .agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 AND latest IS NOT NULL").drop("n"))
    if fits(groups, BROADCAST_GROUPS):
        groups = F.broadcast(groups)
    rows = rows.join(groups, ["digest", "bytes"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("latest"))
    rows = rows.withColumn("refers_to", F.when(F.col("latest").isNotNull() & other, F.col("latest")))
    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_archives_written(folder), "path string, records long")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, payload binary"


def _archives_read(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                found, held, count = [], 0, 0
                with reading(path) as file:
                    for raw in read_archive(file):
                        record = parse_record(raw)
                        if not with_payload:
                            record["payload"] = None
                        found.append(record)
                        held += len(record["payload"] or b"") + 200
                        count += 1
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                if records is not None and count != records:
                    raise WarcError(f"{path} holds {count} records, {records} were written")
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives of ``manifest(path, records)``, with its payload if asked for.

    Archives of others are read too: with a null ``records`` their number is not checked. Records of
    other types than response and revisit come along; ids that no page of ours has are only in
    ``record_id`` and ``refers_to_id``, and page_id is null.
    """
    return manifest.repartition(max(manifest.count(), 1), "path").mapInArrow(_archives_read(with_payload), _READ)


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose original is not among ``records``, or has another payload digest or length."""
    whole = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), "payload_digest", F.col("payload_bytes").alias("whole_bytes"))
    revisits = records.where("record_type = 'revisit' AND refers_to_id IS NOT NULL")
    same = (revisits["refers_to_id"] == whole["refers_to_id"]) & (revisits["payload_digest"] == whole["payload_digest"])
    return revisits.join(whole, same & (revisits["payload_bytes"].isNull() | (revisits["payload_bytes"] == whole["whole_bytes"])), "left_anti")


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
  m AS (SELECT *, CASE WHEN payload_bytes >= {SMALLEST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS latest FROM d)
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM m"""


@query("op1_warc", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    manifest = durable(write_archives(table(spark, sf_dir, "pages"), scratch_folder(spark, "warc")))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
