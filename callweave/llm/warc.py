"""WARC archives: records compressed one by one with a Zstandard dictionary that leads the file."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, as_table, fresh_path, id_in, id_out, meet

# Fixed values of the .warc.zst layout: a skippable frame with this magic number carries the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Payloads from this size on may be replaced by a revisit record.
LEAST_REVISIT = 100
#: Uncompressed bytes after which a writer begins another archive.
ROLL = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def record(kind: str, page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has no payload but says where it is."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url if c > ' ')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A Zstandard dictionary; too few samples for training give their own bytes as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary + b"".join(packed.compress(r) for r in records)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, from its bytes alone."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame leads the archive")
    dictionary = data[8 : 8 + n]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = memoryview(data)[8 + n :]
    while len(rest):
        one = plain.decompressobj()
        out = one.decompress(rest)
        if not one.eof:
            raise ValueError("the last record is cut off")
        yield out
        rest = rest[len(rest) - len(one.unused_data) :]


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def decide(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another, once each.

    Digests and ids alone move.  A digest's first page is found after a partial
    aggregate; rows of a hot digest are dealt over copies of its one answer.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.where(F.octet_length(payload) >= least).select(id_in(id_col).alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    firsts = as_table(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-pages")
    return meet(rows, firsts, "digest", "page_id").where("first <> page_id").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, sample: int = 400, roll: int = ROLL) -> DataFrame:
    """Write .warc.zst archives for all pages into `folder`; returns (archive, records, bytes) by archive.

    Of pages with equal payloads of at least `least` bytes, that with the smallest
    id is a response, the others revisit it; smaller payloads are all responses.
    The dictionary is trained once, from at most `sample` payloads with the least
    hash of the id (at most 64 KB of each), and leads every archive.

    `folder` is any URI that the executors share and pyarrow can write.  A file's
    name follows from its partition and it appears by a rename, so a repeated task
    replaces what a lost one wrote.  Null html is an empty payload, null urls are
    empty, a null id is written as the largest long; repeated rows are records
    each; other columns are ignored; an empty table writes nothing.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    full = pages.where(F.octet_length(F.col(html_col)) > 0).withColumn("_h", F.xxhash64(F.col(id_col)))
    last = full.select("_h").orderBy("_h").limit(sample).agg(F.max("_h").alias("m")).first()["m"]  # hashes alone are ranked, so no task sends payloads that are not drawn
    drawn = full.where(F.col("_h") <= F.lit(last)).select("_h", F.substring(html, 1, 1 << 16).alias("s")).orderBy("_h", "s").limit(sample).collect() if last is not None else []
    dictionary = train_dictionary([record("response", 0, "http://example.org/", bytes(r["s"]), "0" * 64, None) for r in drawn]) if drawn else b""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, top = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(top, recursive=True)
        number = 0

        def close(records: list[bytes]) -> dict:
            nonlocal number
            name = f"part-{ctx.partitionId():06d}-{number:04d}.warc.zst"
            number += 1
            data = archive(records, dictionary)
            attempt = f"{top}/.{name}.{ctx.taskAttemptId()}"
            with store.open_output_stream(attempt) as out:
                out.write(data)
            store.move(attempt, f"{top}/{name}")
            return {"archive": name, "records": len(records), "bytes": len(data)}

        held, size, done = [], 0, []
        for pdf in it:
            for page, url, payload, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"], strict=True):
                held.append(record("response" if refers == NO_ID else "revisit", page, url, payload, digest.hex(), None if refers == NO_ID else refers))
                size += len(held[-1])
                if size >= roll:
                    done.append(close(held))
                    held, size = [], 0
        if held:
            done.append(close(held))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    rows = pages.select(id_in(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("payload"), F.unhex(F.sha2(html, 256)).alias("digest"))
    joined = rows.join(decide(pages, id_col, html_col, least), ["page_id", "digest"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.coalesce("refers_to", F.lit(NO_ID)).alias("refers_to")).mapInPandas(run, "archive string, records long, bytes long")


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, said_bytes long, said_digest string, payload_bytes long, payload_digest string"


def records(spark, folder: str) -> DataFrame:
    """All records of the archives in `folder`: what their headers say, the payload, and its measured length and digest."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                out, size = [], 0
                for raw in read_archive(data):
                    f = parse(raw)
                    p = f["payload"]
                    out.append((int(f["X-Page-ID"]), f["WARC-Target-URI"], f["WARC-Type"], int(f.get("X-Refers-To-Page-ID", NO_ID)), p, int(f["X-Payload-Bytes"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), len(p), hashlib.sha256(p).hexdigest()))
                    size += len(p)
                    if size > 4 << 20:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
                yield pd.DataFrame(out, columns=names)

    names = [f.split()[0] for f in RECORD.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return id_out(files.mapInPandas(run, RECORD), "page_id", "refers_to")


def resolved(found: DataFrame) -> DataFrame:
    """Records with a revisit's length and digest taken from the payload of the response it refers to, and `intact`.

    A record is intact if what was measured is what its header says; a revisit whose
    response is missing or has another payload has neither length nor digest.
    Responses that many revisit are met by salted copies of their one line.
    """
    rest = [c for c in found.columns if c not in ("payload_bytes", "payload_digest", "said_bytes", "said_digest")]
    asked = found.where("record_type = 'revisit'").withColumn("_key", F.concat_ws(":", "refers_to", "said_digest"))
    answers = found.where("record_type = 'response'").select(F.concat_ws(":", "page_id", "payload_digest").alias("_key"), "payload_bytes", "payload_digest").distinct()
    sizes = as_table(asked.groupBy("_key").agg(F.count("*").alias("n")).join(answers, "_key", "left"), "revisited")
    revisits = meet(asked.drop("payload_bytes", "payload_digest"), sizes, "_key", "page_id")
    intact = F.coalesce((F.col("said_bytes") == F.col("payload_bytes")) & (F.col("said_digest") == F.col("payload_digest")), F.lit(False)).alias("intact")
    out = [*rest, "payload_bytes", "payload_digest", intact]
    return found.where("record_type <> 'revisit'").select(out).unionByName(revisits.select(out))


def read(spark, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, intact) of all archives in `folder`.

    Lengths and digests are measured on the payloads read, see `resolved`; a
    revisit's own payload is empty.  An empty folder gives no rows.
    """
    return resolved(records(spark, folder))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder, read the archives back and give what they hold, but for the payloads."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    if not write(pages, folder).agg(F.sum("records").alias("n")).first()["n"]:
        return resolved(spark.createDataFrame([], RECORD).drop("payload"))
    return resolved(as_table(records(spark, folder).drop("payload"), "records"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
