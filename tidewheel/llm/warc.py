"""WARC archives with a Zstandard dictionary.

Every archive file starts with a skippable frame that holds a Zstandard dictionary built from a
bounded sample of the records; each record is then a frame of its own, compressed with that
dictionary, so a record can be read alone. A record whose payload repeats that of another page (of
at least ``min_bytes`` bytes) is a revisit of the page with the smallest id.

Archives go to the folder that all executors share. A task attempt writes files under names of its
own and renames them when complete. The list of files comes back through Spark, which commits one
attempt of each task, so it says which files count; those of other attempts are never read, and
``without_strays`` deletes them.

A null payload is empty; null ids are written as empty fields and come back null, and are never
referred to unless all copies have null ids; rows that share the smallest id are all responses;
repeated rows have a record each; payloads of any length are written whole; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

MIN_BYTES = 100
#: The magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
#: The sample for the dictionary: about so many records (at most twice as many), each of at most so many bytes.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 8 * 1024
#: Parts that the copies of one page are dealt into.
SALTS = 8
#: Pages that a writer holds as Python objects at once.
ROWS_AT_ONCE = 64
#: An archive file is closed when it has so many bytes.
FILE_BYTES = 32_000_000


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the samples themselves if there are too few to train from."""
    whole = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, whole // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no block."""
    block = payload if kind == "response" else b""
    name = "" if page_id is None else page_id
    heads = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:page:{name}>".encode(), b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(), f"WARC-Payload-Digest: sha256:{digest}".encode(), f"X-Payload-Length: {len(payload)}".encode()]
    if kind == "revisit":
        heads += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    return b"\r\n".join([*heads, f"Content-Length: {len(block)}".encode(), b"", block]) + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of a record; a response's digest and length are taken from its block and must equal its header's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    kind = fields[b"WARC-Type"].decode()
    digest, length = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), int(fields[b"X-Payload-Length"])
    own = lambda k: int(x) if (x := fields[k].decode().removeprefix("<urn:page:").removesuffix(">")) not in ("", "None") else None
    if kind == "response":
        block = rest[: int(fields[b"Content-Length"])]
        if hashlib.sha256(block).hexdigest() != digest or len(block) != length:
            raise ValueError(f"record {own(b'WARC-Record-ID')} is damaged")
    return {"page_id": own(b"WARC-Record-ID"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": own(b"WARC-Refers-To") if kind == "revisit" else None}


def _store(folder: str):
    """The file system and path of a folder, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def marked(df: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to. Only digests and ids are shuffled to find first copies, pre-aggregated. Pages are joined with them by digest and a salt, so copies of one page go to many tasks."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    pages = pages.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "long_enough": F.octet_length("payload") >= min_bytes})
    firsts = pages.where("long_enough").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("shared"), "first_id")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = pages.withColumn("own_salt", F.when(F.col("long_enough"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")))
    out = pages.join(firsts, (F.col("digest") == F.col("shared")) & (F.col("own_salt") == F.col("salt")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def sample_of(df: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[bytes]:
    """About so many payloads' beginnings, at most twice as many: those whose hash falls under a threshold that follows from the count, so tasks send no more however many they are. A bounded sample for the dictionary alone."""
    share = min(1.0, rows / max(1, df.count()))
    chosen = df.select(F.xxhash64("html", "page_id").alias("h"), F.substring("html", 1, most).alias("s")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    found = chosen.where("s is not null and s <> ''").orderBy("h", "s").limit(2 * rows).collect()
    return [r["s"].encode() for r in found]


def write_archives(records: DataFrame, dictionary: bytes, folder: str, level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; returns path, records, bytes of each file. It writes when the result is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store.create_dir(root, recursive=True)
        files, out, name, n = [], None, "", 0

        def close() -> None:
            out.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            files.append((f"{root}/{name}", n, size))

        size = 0
        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, ROWS_AT_ONCE) for r in batch.slice(k, ROWS_AT_ONCE).to_pylist()):
                if out is None:
                    name, n, size = f"part-{part:06d}-{attempt}-{len(files):04d}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{root}/.{name}", compression=None)
                    out.write(head := dictionary_frame(dictionary))
                    size += len(head)
                frame = coder.compress(record(row["page_id"], row["url"], row["payload"].encode(), row["digest"], row["kind"], row["refers_to"]))
                out.write(frame)
                size += len(frame)
                n += 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], names=["path", "records", "bytes"])

    return records.mapInArrow(run, "path string, records long, bytes long")


def records_in(source) -> Iterator[bytes]:
    """The records of one archive, from a binary stream that is read piece by piece."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(source.read(n))
    rest = b""
    while True:
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        found = []
        while not decoder.eof:
            rest = rest or source.read(1 << 20)
            if not rest:
                break
            found.append(decoder.decompress(rest))
            rest = decoder.unused_data if decoder.eof else b""
        if not decoder.eof:
            if found and any(found):
                raise ValueError("the archive ends within a record")
            return
        yield b"".join(found)


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """files: a column path. One row for each record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(path, compression=None) as source:
                    for raw in records_in(source):
                        rows.append(parsed(raw))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names=names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names=names)

    return files.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def without_strays(files: DataFrame, folder: str) -> int:
    """Deletes the archives of a folder that the list (a column path) doesn't have; how many. It goes through both in order, file by file."""
    store, root = _store(folder)
    from pyarrow import fs

    listed = (r[0] for r in files.select("path").orderBy("path").toLocalIterator())
    gone, want = 0, next(listed, None)
    for name in sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.is_file):
        while want is not None and want < name:
            want = next(listed, None)
        if want != name:
            store.delete_file(name)
            gone += 1
    return gone


def archived(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes df's pages to archives and reads them back."""
    spark = df.sparkSession
    folder = folder or new_path(spark, "warc")
    dictionary = build_dictionary(sample_of(df))
    listing = f"{folder}-files"
    write_archives(marked(df), dictionary, folder).write.parquet(listing)
    files = spark.read.parquet(listing)
    return read_archives(files.repartition(max(1, files.count()), "path"), folder)


def op1_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f"""
