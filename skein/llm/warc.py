"""WARC archives with a Zstandard dictionary.

Each archive is one file: a skippable frame that holds the dictionary, then every record as a Zstandard frame of
its own, compressed with that dictionary. The writer returns an index of every record's place, and any record can be
read alone by it (`read_record`); `read` goes by the index too. The dictionary is built from a bounded sample of the
archived records: `DICT_SAMPLES` of them, spread evenly over the archive, and of each `DICT_PIECES` pieces of
`DICT_PIECE_BYTES`, spread evenly over the record. It is at most `DICT_BYTES` long. Where there is too little to train
on, the pieces themselves are the dictionary; every archive has one.

Records with equal payloads of at least `REVISIT_BYTES` bytes are stored once: the one with the largest page_id is
a response, the others are revisit records that name it, its digest and the payload's length. Which those are is
found on digests alone; the payloads are shuffled once, to the archives, dealt by page_id and digest. Archives are of
about `ARCHIVE_BYTES`; a task writes up to `ARCHIVES_PER_TASK` of them, one after another. A file is written under a
name of its own attempt and renamed, and reads go by the index that the writing job returned: attempts that were lost
leave no record behind.

Defined cases: null html is an empty payload; a payload of any length is one record; a null url is left out of the
record, and what a header can't hold is percent-encoded; a null page_id is archived too, and never is what a revisit
refers to; rows of one page_id with equal large payloads: one of them is the response, and rows repeated whole are
records of their own, each with its own WARC-Record-ID; an empty table gives no archive and no rows; further columns
aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_slices, materialize, small_batches, table

SKIPPABLE = 0x184D2A5D
DICT_BYTES, DICT_SAMPLES, DICT_PIECES, DICT_PIECE_BYTES, LEVEL = 64 << 10, 400, 4, 1 << 10, 3
REVISIT_BYTES = 1000
ARCHIVE_BYTES, ARCHIVES_PER_TASK = 16 << 20, 16
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, kind: str, digest: str, nth: int = 0) -> str:
    """Rows repeated whole are told apart by `nth`; a response that revisits name is always the first."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {kind} {digest} {nth}')}>"


def record(kind: str, page_id, url, payload: bytes, n_bytes: int, digest: str, refers_to=None, nth: int = 0) -> bytes:
    key = "none" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(key, kind, digest, nth)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([] if url is None else [("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url))]),
        ("X-Page-Id", key),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(n_bytes)),
        *([] if kind != "revisit" else [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, "response", digest)), ("X-Refers-To-Page-Id", str(refers_to))]),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(payload))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its block")
    return fields, rest[:n]


def pieces_of(raw: bytes) -> bytes:
    """A record, or `DICT_PIECES` pieces of a long one, spread evenly from its begin to its end."""
    if len(raw) <= DICT_PIECES * DICT_PIECE_BYTES:
        return raw
    step = (len(raw) - DICT_PIECE_BYTES) / (DICT_PIECES - 1)
    return b"".join(raw[int(i * step) :][:DICT_PIECE_BYTES] for i in range(DICT_PIECES))


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spread records: trained, or else the samples' own bytes."""
    import zstandard as zs

    step = max(1, len(records) // DICT_SAMPLES)
    samples = [pieces_of(r) for r in records[::step]]
    if len(samples) >= 16:
        try:
            return zs.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8).as_bytes()
        except zs.ZstdError:
            pass
    return b"".join(samples)[-DICT_BYTES:]


def write_archive(out, records: list[bytes]) -> list[tuple[int, int]]:
    """Write an archive; offset and length of each record's frame."""
    import zstandard as zs

    raw = build_dictionary(records)
    at, places = out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw), []
    how = zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(raw), write_checksum=True)
    for r in records:
        frame = how.compress(r)
        out.write(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return places


def decompressor(head: bytes):
    """For an archive that begins with `head`, which holds its whole skippable frame."""
    import zstandard as zs

    magic, n = struct.unpack_from("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary")
    return zs.ZstdDecompressor(dict_data=zs.ZstdCompressionDict(head[8 : 8 + n]))


def read_archive(data: bytes, places: Iterable[tuple[int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records at `places` (offset, length) of an archive."""
    how, view = decompressor(data), memoryview(data)
    for at, n in places:
        yield parse(how.decompress(view[at : at + n]))


def read_record(path: str, at: int, n: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, without reading the others."""
    files, where = filesystem(path)
    with files.open_input_file(where) as src:
        head = src.read_at(8, 0)
        head += src.read_at(struct.unpack_from("<II", head)[1], 8)
        return parse(decompressor(head).decompress(src.read_at(n, at)))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: what has none lies in the session's default file system, not on a worker's disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def filesystem(uri: str):
    """(file system, path) for a URI; Hadoop's names of S3 are understood."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} has no scheme")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest -> refers_to, for payloads that several pages share. Payloads themselves aren't shuffled."""
    n = F.coalesce(F.octet_length("html"), F.lit(0))
    big = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), n.alias("n")).where(n >= least)
    big = materialize(big, "warc-digests")
    top = big.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1 and refers_to is not null")
    held = big.join(top, ["digest", "n"]).select("page_id", "digest", "refers_to")
    return held.groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to"))


INDEX = "path string, at long, length long, page_id long"


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive pages (page_id, url, html) under `folder`; the index: path, at, length, page_id of every record."""
    spark = pages.sparkSession
    folder = qualified(spark, folder).rstrip("/")
    total = pages.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 500), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], INDEX)
    # As many tasks as there are archives while those are few, then several archives to a task.
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(in_slices(total, archive_bytes), max(in_slices(total, archive_bytes * ARCHIVES_PER_TASK), most))
    # One shuffle brings pages and links to the archives: both are dealt by page_id and digest, and joined there.
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    links = revisits(pages).select(key.alias("__k"), "digest", "refers_to")
    own = small_batches(pages).select(key.alias("__k"), "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    both = own.repartition(parts, "__k", "digest").join(links.repartition(parts, "__k", "digest"), ["__k", "digest"], "left")
    both = both.select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "digest")

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, where = filesystem(folder)
        files.create_dir(where, recursive=True)
        held, ids, size = [], [], 0
        last, times = None, Counter()  # rows of one page_id and digest follow one another

        def flush() -> pd.DataFrame:
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{where}/.{name}", compression=None) as out:
                places = write_archive(out, held)
            files.move(f"{where}/.{name}", f"{where}/{name}")
            return pd.DataFrame({"path": f"{folder}/{name}", "at": [a for a, _ in places], "length": [n for _, n in places], "page_id": pd.array(ids, "Int64")})

        for f in frames:
            for page_id, url, payload, digest, refers in zip(f.page_id, f.url, f.payload, f.digest, f.refers_to):
                page_id = None if pd.isna(page_id) else int(page_id)
                refers = None if pd.isna(refers) else int(refers)
                if last != (page_id, digest):
                    last, times = (page_id, digest), Counter()
                if refers is not None and refers == page_id and not times["response"]:
                    refers = None
                url = None if url is None or url != url else url
                kind, body = ("response", payload) if refers is None else ("revisit", b"")
                held.append(record(kind, page_id, url, body, len(payload), digest, refers, times[kind]))
                ids.append(page_id)
                times[kind] += 1
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, ids, size = [], [], 0
        if held:
            yield flush()

    return materialize(both.mapInPandas(archive, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The indexed records: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, data = None, b""
        for f in frames:
            rows, size = [], 0
            for own, part in f.groupby("path", sort=False):
                if own != path:
                    files, where = filesystem(own)
                    with files.open_input_stream(where, compression=None) as src:
                        path, data = own, src.read()
                for head, body in read_archive(data, zip(part["at"].tolist(), part["length"].tolist())):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(head["X-Payload-Length"])
                    if kind == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"a payload in {path} isn't what was archived")
                    key = head["X-Page-Id"]
                    rows.append((None if key == "none" else int(key), head.get("WARC-Target-URI"), kind, n, digest, head.get("X-Refers-To-Page-Id"), body))
                    size += len(body)
                    if size > 4 << 20:
                        yield frame(rows)
                        rows, size = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
        out["page_id"] = out["page_id"].astype("Int64")
        out["refers_to"] = pd.to_numeric(out["refers_to"]).astype("Int64")
        return out

    # An archive is read by one task, in the order of its records.
    n = max(1, index.select("path").distinct().count())
    return index.repartition(n, "path").sortWithinPartitions("path", "at").mapInPandas(records, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fresh_path(spark, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

QUERIES = {"op2_warc": op2_warc}
SQL = {"op2_warc": OP2_SQL}
