"""Fixity audit of WARC replicas by Merkle trees.

Pages are written as WARC response records, one gzip member each, in files of
bounded size.  An index lists every record's offset range.  An audit hashes
every range of every replica, its offset, length and bytes, into a leaf; the
leaf of a file's last record has the length of the file too.  Every ``FAN``
nodes in order are hashed into one above, up to one root for a replica.  Roots
are compared first; below a pair of nodes that agree nothing is looked at, and
the leaves at which a descent ends are the damaged records.  What can't be read
has no hash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, partitions, staged, text_mb

#: Bytes of a file after which the next one begins, and children of a node.
FILE, FAN = 16 << 20, 16
DATE = "1970-01-01T00:00:00Z"


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC/1.1 response record in a gzip member; the same bytes for the same page every time."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{url or ''}")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Block-Digest: {_digest(body)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + body + b"\r\n\r\n", compresslevel=6, mtime=0)


def sound(member: bytes) -> bool:
    """Whether a record unpacks and its block has the digest that its header names."""
    try:
        head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        return _digest(rest[: int(fields[b"Content-Length"])]).encode() == fields[b"WARC-Block-Digest"]
    except (OSError, EOFError, ValueError, KeyError, zlib.error):
        return False


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_INDEX = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("idx", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _write(folder: str):
    def run(batches):
        part, seq, fs_where = TaskContext.get().partitionId(), 0, pyarrow.fs.FileSystem.from_uri(folder)
        fs, where = fs_where
        fs.create_dir(where, recursive=True)
        stream, name, at, idx, rows = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    # Files of a task that runs again have other names, and no index lists the first ones.
                    name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.warc.gz"
                    stream, at, idx = fs.open_output_stream(f"{where}/{name}", compression=None), 0, 0
                data = record(page_id, url, html)
                stream.write(data)
                rows.append((part, seq, f"{folder}/{name}", idx, page_id, url, at, len(data)))
                at, idx = at + len(data), idx + 1
                if at >= FILE:
                    stream.close()
                    stream, seq = None, seq + 1
            yield _batch(rows, _INDEX)
            rows = []
        if stream is not None:
            stream.close()

    return run


def write_warc(pages: DataFrame) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) to WARC files in the shared folder; gives their index.

    Records are in order of page_id, then url.  Null ids come first; null urls
    and pages count as empty.  Repeated rows are all written.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    by = [F.col("page_id").asc_nulls_first(), F.col("url")]
    ordered = rows.repartitionByRange(partitions(spark, text_mb(rows, "html")), *by).sortWithinPartitions(*by, "html")
    written = ordered.mapInArrow(_write(fresh_path(spark, "warc")), "part long, seq long, path string, idx long, page_id long, url string, at long, size long")
    written = staged(written, "records")
    # Records are numbered through; the running sum is over files, one for each 16 MB.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = written.groupBy("part", "seq").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = staged(files.select("part", "seq", "base"), "files")
    return staged(written.join(files, ["part", "seq"]).withColumn("leaf", (F.col("base") + F.col("idx")).cast("long")).drop("base", "idx"), "index")


def _files(index: DataFrame, *more) -> DataFrame:
    """One row for each file with its records' ranges in order; a file is of bounded size, and so is the list."""
    ranges = F.sort_array(F.collect_list(F.struct("leaf", "at", "size", *more))).alias("ranges")
    return index.groupBy("part", "seq", "path").agg(ranges)


def _copy(folder: str):
    def run(batches):
        for batch in batches:
            out = []
            for part, seq, path, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, source = pyarrow.fs.FileSystem.from_uri(path)
                target_fs, where = pyarrow.fs.FileSystem.from_uri(folder)
                target_fs.create_dir(where, recursive=True)
                name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_file(source) as have, target_fs.open_output_stream(f"{where}/{name}", compression=None) as put:
                    for r in ranges:
                        data = bytearray(have.read_at(r["size"], r["at"]))
                        if r["harm"]:
                            data[len(data) // 2] ^= 0x5A
                        put.write(bytes(data))
                out.append((part, seq, f"{folder}/{name}"))
            yield _batch(out, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string())]))

    return run


def replicate(index: DataFrame, harm=None) -> DataFrame:
    """Copy all files; gives ``part``, ``seq`` and ``path`` of the copies.

    ``harm`` (a condition over the index) names records of which one byte is
    changed on the way: a drill that an audit must find.
    """
    marked = index.withColumn("harm", F.coalesce(harm, F.lit(False)) if harm is not None else F.lit(False))
    return staged(_files(marked, "harm").mapInArrow(_copy(fresh_path(index.sparkSession, "replica")), "part long, seq long, path string"), "copies")


_LEAF = pa.schema([("node", pa.int64()), ("hash", pa.binary()), ("record", pa.binary())])


def _opened(path: str | None):
    """The file at ``path``, or None if there is none."""
    try:
        fs, where = pyarrow.fs.FileSystem.from_uri(path or "")
        return fs.open_input_file(where)
    except (OSError, ValueError):
        return None


def _range(have, size: int, at: int) -> bytes | None:
    """The bytes of a range, or None if they can't be read in full."""
    try:
        data = have.read_at(size, at) if have is not None else b""
    except OSError:
        return None
    return data if have is not None and len(data) == size else None


def _length(have) -> int:
    try:
        return have.size() if have is not None else -1
    except OSError:
        return -1


def leaf_hash(at: int, size: int, data: bytes, length: int | None = None) -> bytes:
    """The hash of a record's place and bytes, and of the file's ``length`` for its last record."""
    place = struct.pack("<qqq", at, size, -1 if length is None else length)
    return hashlib.sha256(place + data).digest()


def _leaves(batches):
    for batch in batches:
        for path, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have, rows = _opened(path), []
            end = ranges[-1]["leaf"]
            for r in ranges:
                data = _range(have, r["size"], r["at"])
                if data is None:
                    rows.append((r["leaf"], None, None))
                else:
                    rows.append((r["leaf"], leaf_hash(r["at"], r["size"], data, _length(have) if r["leaf"] == end else None), hashlib.sha256(data).digest()))
            if have is not None:
                have.close()
            yield _batch(rows, _LEAF)


def merkle(index: DataFrame, files: DataFrame) -> list[DataFrame]:
    """The levels of the tree over a replica's ``files`` (part, seq, path): node and hash, leaves first, the root last.

    A file that is not listed, or can't be read, has leaves without a hash.
    Leaves also have ``record``, the hash of the bytes alone.
    """
    ranges = _files(index).drop("path").join(files, ["part", "seq"], "left")
    levels = [staged(ranges.select("path", "ranges").mapInArrow(_leaves, "node long, hash binary, record binary"), "leaves")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last > 0:
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: F.coalesce(F.hex(x["hash"]), F.lit("-")))
        above = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("up")).agg(F.unhex(F.sha2(F.array_join(children, ""), 256)).alias("hash"))
        levels.append(staged(above.select(F.col("up").alias("node"), "hash"), "nodes"))
        last //= FAN
    return levels


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The leaves (``node``) at which two trees of the same index differ, found from the roots down."""
    suspects = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if suspects is not None:  # only what is below nodes that differ
            x, y = (t.select("node", "hash").join(suspects.withColumnRenamed("node", "up"), F.expr(f"node div {FAN}") == F.col("up"), "left_semi") for t in (x, y))
        both = x.select("node", F.col("hash").alias("hash_a")).join(y.select("node", F.col("hash").alias("hash_b")), "node", "full")
        suspects = staged(both.where("NOT hash_a <=> hash_b").select("node"), "suspects")
    return suspects


def _verify(batches):
    for batch in batches:
        leaf, ok = batch.column(0), []
        for path, at, size, last in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            have = _opened(path)
            data = _range(have, size, at)
            ok.append(data is not None and sound(data) and (not last or _length(have) == at + size))
            if have is not None:
                have.close()
        yield pa.RecordBatch.from_arrays([leaf, pa.array(ok, pa.bool_())], ["node", "sound"])


def audit(index: DataFrame, replicas: list[DataFrame]) -> DataFrame:
    """One row per record: ``page_id``, ``url``, ``part``, ``seq``, ``at``, ``size``, ``leaf``, ``sha256``, ``intact`` and ``bad_replicas``.

    ``replicas`` list their files (part, seq, path); the first one's leaves give
    ``sha256``, null where it lost the record.  A record is ``intact`` if all
    replicas hold the same bytes in the same place; otherwise ``bad_replicas``
    has the numbers of those whose record is lost, cut off or does not have the
    digest that it names.  Bytes after a file's last record count as damage of
    that record, and so do files that are missing or not listed of all their
    records.  With one replica there is nothing to compare, so every record is
    held against the digest that it names.  Repeated pages are records of their
    own; an empty index gives an empty result.  A record of any length is read
    and hashed whole, one at a time.
    """
    trees = [merkle(index, files) for files in replicas]
    # What no replica has looks the same in all trees.
    suspects = [trees[0][0].where("hash IS NULL" if len(trees) > 1 else "TRUE").select("node")]
    suspects += [differing(trees[0], t) for t in trees[1:]]
    suspects = staged(reduce(DataFrame.unionByName, suspects).distinct(), "all-suspects")
    ends = index.groupBy("part", "seq").agg(F.max("leaf").alias("end"))
    at = index.join(suspects.withColumnRenamed("node", "leaf"), "leaf", "left_semi").join(ends, ["part", "seq"])
    at = at.select(F.col("leaf").alias("node"), "part", "seq", "at", "size", (F.col("leaf") == F.col("end")).alias("last"))
    bad = []
    for k, files in enumerate(replicas):
        checked = at.join(files, ["part", "seq"], "left").select("node", "path", "at", "size", "last").mapInArrow(_verify, "node long, sound boolean")
        bad.append(checked.where("NOT sound").select("node", F.lit(k).alias("replica")))
    bad = reduce(DataFrame.unionByName, bad).groupBy("node").agg(F.sort_array(F.collect_list("replica")).alias("bad"))
    bad = suspects.join(bad, "node", "left" if len(replicas) > 1 else "inner")
    bad = bad.select(F.col("node").alias("leaf"), F.coalesce("bad", F.expr("cast(array() as array<int>)")).alias("bad"))
    out = index.join(trees[0][0].select(F.col("node").alias("leaf"), F.lower(F.hex("record")).alias("sha256")), "leaf").join(staged(bad, "bad"), "leaf", "left")
    return out.select("page_id", "url", "part", "seq", "at", "size", "leaf", "sha256", F.col("bad").isNull().alias("intact"), F.coalesce("bad", F.expr("cast(array() as array<int>)")).alias("bad_replicas"))


#: In the drill, one record in about this many is harmed.
DRILL = 500


def op6_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC, copied with a drill's damage, and audited."""
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    copies = replicate(index, F.crc32(F.col("page_id").cast("string").cast("binary")) % DRILL == 0)
    return audit(index, [index.select("part", "seq", "path").distinct(), copies])


QUERIES = {"op6_warc_fixity": op6_warc_fixity}
ORACLE_SQL: dict[str, str] = {}
