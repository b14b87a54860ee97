"""Token ids in sorted-string-table shards.

A shard is one file that holds documents in ascending order of their keys:

* data blocks of about ``BLOCK`` bytes; an entry is (shared key bytes, other key
  bytes, value bytes: three varints), the rest of the key, and the ids; a
  CRC-32 of the block ends it;
* a Bloom filter over the keys;
* a sparse index: the first key, offset and length of each block;
* a footer of fixed size: where filter and index are, the number of documents
  and ids, the bytes of an id, and a magic word.

A look-up reads the footer, filter and index, asks the filter, finds the block
by binary search, and reads that block only.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .shared import fresh_path, partitions, staged, text_mb

#: Bytes of a data block, and of a shard after which the next one begins.
BLOCK, SHARD = 64 << 10, 16 << 20
#: Bits of the Bloom filter for each key, and look-ups.
BITS, LOOKUPS = 10, 7
#: The id that ends every document.
END = 0
MAGIC = b"SSTTOK01"
FOOTER = struct.Struct("<QQQQQQQ8s")
#: Ranges of keys that a look-up is dealt over, at most.
RANGES = 1000
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1 << 19


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the ids do; null sorts first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_slots(key: bytes, bits: int):
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + j * b) % bits for j in range(LOOKUPS)]


class ShardWriter:
    """Writes one shard to a stream; keys must not descend."""

    def __init__(self, stream, width: int, block_size: int = BLOCK):
        self.stream, self.width, self.block_size = stream, width, block_size
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.first_of_block = b""
        self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.first_of_block, self.last = key, b""
        shared = 0
        if key == self.last:
            shared = len(key)
        else:
            while shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(value) // self.width
        if len(self.block) >= self.block_size:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.stream.write(data)
            self.index.append((self.first_of_block, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS * len(self.keys) // 8 * 8 + 8)
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[_bloom_slots(key, bits)] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        self.stream.write(bloom + index)
        self.stream.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), len(self.keys), self.n_ids, self.width, MAGIC))
        self.stream.close()


class ShardReader:
    """Reads a shard: all of it in order, or one document."""

    def __init__(self, path: str):
        fs, where = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        self.bloom_at, self.bloom_size, index_at, index_size, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.first, self.blocks = [], []
        data, at = self._read(index_at, index_size), 0
        while at < len(data):
            n, at = read_varint(data, at)
            self.first.append(data[at : at + n])
            offset, at = read_varint(data, at + n)
            length, at = read_varint(data, at)
            self.blocks.append((offset, length))
        self.bloom: bytes | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int):
        """The (key, value) pairs of a block."""
        data = self._read(*self.blocks[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key, end = 0, b"", len(data) - 4
        while at < end:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def entries(self):
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<u2" if self.width == 2 else "<u4").astype("<u4")

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, or None; the first if it was written more than once."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, self.bloom_size)
        bits = len(self.bloom) * 8
        if not all(self.bloom[s >> 3] >> (s & 7) & 1 for s in _bloom_slots(key, bits)):
            return None
        k = max(0, bisect_right(self.first, key) - 1)
        while k > 0 and self.first[k] == key:  # equal keys may span blocks
            k -= 1
        for k in range(k, len(self.blocks)):
            if self.first[k] > key:
                break
            for found, value in self.block(k):
                if found == key:
                    return self.ids(value)
        return None


class _Known(dict):
    """The ids of pieces; one that is not there is encoded, and all are forgotten when there are too many."""

    def __init__(self, coder: Encoder):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = self.coder.piece(piece)
        return out


class Encoder:
    """Ids by the ``tokenizers`` library, which sees every distinct piece of text once.

    The vocabulary cuts a text into pieces that are encoded one by one, so the
    ids of pieces seen before are looked up, and a new one goes to the
    library's model as the symbols of its bytes.  Texts with characters above
    U+00FF or with a special token go to the library whole.
    """

    SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
    LETTER, DIGIT = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.pieces = re.compile(
            rf" ?[{self.LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{self.DIGIT}]+| ?[^{self.SPACE}{self.LETTER}{self.DIGIT}]+|[{self.SPACE}]+(?![^{self.SPACE}])|[{self.SPACE}]+"
        )
        self.model, self.symbols = self.library.model, dict(enumerate(byte_symbols()))
        self.known = _Known(self)

    def piece(self, text: str) -> bytes:
        """The ids of one piece."""
        symbols = text.encode().decode("latin-1").translate(self.symbols)
        return array("H" if self.width == 2 else "I", [x.id for x in self.model.tokenize(symbols)]).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._library([text])[0]
        if any(x in text for x in self.special):
            return self._library([text])[0]
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_MANIFEST = "part long, seq long, path string, first_key binary, n_docs long, n_ids long"


def _write(tokenizer: str, folder: str, block: int, shard: int):
    def run(batches):
        coder = encoder(tokenizer)
        end = np.array([END], dtype=coder.kind).tobytes()
        part = TaskContext.get().partitionId()
        fs, where = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(where, recursive=True)
        rows: list[tuple] = []
        writer, name = None, ""
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    # A task that runs again writes other files; only those of the one that succeeds are listed.
                    name = f"{part:08d}-{len(rows):06d}-{uuid.uuid4().hex}.sst"
                    writer = ShardWriter(fs.open_output_stream(f"{where}/{name}"), coder.width, block)
                writer.add(key_of(doc_id), coder.encode(text or "") + end)
                if writer.at >= shard:
                    writer.close()
                    rows.append((part, len(rows), f"{folder}/{name}", writer.keys[0], len(writer.keys), writer.n_ids))
                    writer = None
        if writer is not None:
            writer.close()
            rows.append((part, len(rows), f"{folder}/{name}", writer.keys[0], len(writer.keys), writer.n_ids))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "seq", "path", "first_key", "n_docs", "n_ids"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Write the ids of all rows, in ascending order of ``doc_id``, to shards in the shared folder.

    ``block`` and ``shard`` are the bytes after which the next block or shard begins.
    The result, itself a table there, lists the shards in order: ``part``,
    ``seq``, ``path``, ``first_key``, ``n_docs``, ``n_ids`` and ``start`` (ids
    in all shards before).  Each row's ids end with the id 0; null and empty
    texts have that one only.  Null doc_ids come first.  Rows that repeat a
    doc_id are all written, ordered by their texts.  An empty table makes no
    shards; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions(spark, text_mb(rows))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = staged(ordered.mapInArrow(_write(tokenizer, fresh_path(spark, "shards"), block, shard), _MANIFEST), "manifest")
    # One row for each 16 MB of ids, so the running sum is over few rows.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard, out, size = ShardReader(path), [], 0
            for key, value in shard.entries():
                ids = shard.ids(value)
                out.append((id_of(key), start, len(ids), ids.tobytes()))
                start += len(ids)
                size += len(value)
                if size > 4 << 20:
                    yield _documents(out)
                    out, size = [], 0
            yield _documents(out)


def _documents(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: ``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian 32-bit)."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def _get(batches):
    """(doc_id, path, start) in, those of a shard together; the ids of the documents that are there out."""
    path, shard = None, None
    for batch in batches:
        out, size = [], 0
        for doc_id, where, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where != path:
                path, shard = where, ShardReader(where)
            ids = shard.get(doc_id)
            if ids is not None:
                out.append((doc_id, start, len(ids), ids.tobytes()))
                size += len(out[-1][3])
            if size > 4 << 20:
                yield _documents(out)
                out, size = [], 0
        yield _documents(out)


def look_up(manifest: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents of ``wanted`` that the shards have: ``doc_id``, ``n_tokens`` and ``ids``, each once.

    An id is joined with the shards whose keys go around it, within ranges of
    keys of about as many shards each; a shard is opened once, by one task,
    which reads only the blocks that filter and index call for.  Ids that no
    shard has give no row; null is an id like others.  Of documents that share
    an id, the first that was written is found.
    """
    number = lambda c: F.coalesce(c.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)"))
    first = (F.conv(F.hex(F.substring("first_key", 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")
    known = F.when(F.hex(F.substring("first_key", 1, 1)) == "01", first)
    shards = manifest.select("path", "start", number(known).alias("low"), number(F.lead(known).over(Window.orderBy("part", "seq"))).alias("high"), F.lead("path").over(Window.orderBy("part", "seq")).isNull().alias("last"))
    shards = shards.withColumn("high", F.when(F.col("last"), F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).otherwise(F.col("high")))
    cuts = shards.agg(F.percentile_approx("low", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))  # fewer than RANGES numbers
    within = F.array(*[F.lit(c).cast("decimal(20,0)") for c in cuts]) if cuts else F.array().cast("array<decimal(20,0)>")
    place = lambda c: F.size(F.filter(within, lambda x: x < c))
    dealt = shards.select("path", "start", "low", "high", F.explode(F.sequence(place(F.col("low")), place(F.col("high")))).alias("place"))
    asked = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct().withColumn("key", number(F.col("doc_id")))
    met = asked.withColumn("place", place(F.col("key"))).join(dealt, "place").where("key BETWEEN low AND high").select("doc_id", "path", "start")
    found = met.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(_get, "doc_id long, start long, n_tokens long, ids binary")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("n_tokens", "ids"), "start").alias("x")).select("doc_id", "x.*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_shards": op8_token_shards}
ORACLE_SQL: dict[str, str] = {}
