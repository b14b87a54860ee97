"""Byte-pair encoding and decoding as streaming transducers.

From a list of merges follows how far ahead a tokenizer must look: a merge can
only be kept from happening by one of smaller rank that takes its right part
away, which in turn can only be prevented by one of still smaller rank, and so
on.  The longest such chain bounds the lookahead.  The encoder keeps a window
of that many symbols and a fixed block more, and emits the tokens that nothing
to the right of the window can change.  The state is constant, however long a
word or a text is; the text itself is one value of a row.  Decoding reads the
ids again, and a state machine turns the bytes of their names into characters.

A vocabulary file in the ``tokenizers`` JSON format gives the merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import normalizers

from .shared import lean, small_batches

#: Symbols beyond the lookahead that a window holds, words whose tokens a worker remembers, characters read at a time.
BLOCK, REMEMBERED, READ = 4096, 1 << 17, 1 << 16
#: White space, fixed by the library's regular expressions: U+0085 and the Unicode space separators included.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character for each byte, fixed by the byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


def library_nfc(_, text: str) -> str:
    """NFC by the tables of the library, which are older than Python's."""
    return normalizers.NFC().normalize_str(text)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def odd_marks() -> re.Pattern:
    """The characters that the library and Python compose or order differently: found by asking both about every one that could be."""
    own, odd = unicodedata.normalize, []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        if unicodedata.combining(c):
            tries = (f"a\u0315{c}", f"a{c}\u0327", f"a{c}\u0301", f"a\u0334{c}")
        elif unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            tries = (c, own("NFD", c))
        else:
            continue
        if any(own("NFC", x) != library_nfc("NFC", x) for x in tries):
            odd += {c, *own("NFD", c)}
    return re.compile("[" + "".join(map(re.escape, odd)) + "]" if odd else r"(?!)")


#: Lower case of letters that the library knows and Python may not: fixed values.
NEW_CASES = {"\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7da": "\ua7db", "\ua7dc": "\u019b"}
NEW_CASES |= {chr(c): chr(c + 32) for c in range(0x10D50, 0x10D66)} | {chr(c): chr(c + 27) for c in range(0x16EA0, 0x16EB9)}
#: Letters and digits newer than those of the library (Unicode 16), as ranges of code points: fixed values.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF
2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Where a word surely ends within text without white space: after an ASCII digit, or where ASCII letters end.
_SEAM = re.compile(r"(?<=[0-9])(?=[\x00-\x7f])|(?<=[A-Za-z])(?=[\x00-\x40\x5b-\x60\x7b-\x7f])")
_ODD = re.compile("[Σ" + "".join(NEW_CASES) + "]")


class Merges:
    """A merge list over the bytes of words, and what follows from it."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.end) for s in symbols]
        #: Rank and merged token of a pair, in one number.
        self.ranks: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        width: dict[int, int] = {}
        for x in (*self.inner, *self.last):
            if x is not None:
                width[x] = 1
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = self.vocab[a], self.vocab[b]
            # A merged token drops an end-of-word mark that its left part may carry only at its end.
            made = self.vocab[a + b]
            self.ranks.setdefault((left, right), rank << 32 | made)
            if made not in parts:
                parts[made] = (left, right)
                width[made] = width.get(left, 1) + width.get(right, 1)
        self.width = width
        self.longest = max(width.values(), default=1)
        self.lookahead = self._lookahead(parts)

    def _lookahead(self, parts: dict[int, tuple[int, int]]) -> int:
        """How many symbols right of a token can decide whether it is one.

        The reach of a merge is the width of its right part, and from the end
        of each token within that part the reach of every earlier merge that
        begins with that token.
        """
        reach: dict[int, int] = {}  # of the merges so far, by their left part
        most = 0
        for (left, right), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            far, todo = self.width.get(right, 1), [(right, 0)]
            while todo:
                token, start = todo.pop()
                far = max(far, start + self.width.get(token, 1) + reach.get(token, 0))
                if token in parts:
                    a, b = parts[token]
                    todo += [(a, start), (b, start + self.width.get(a, 1))]
            reach[left] = max(reach.get(left, 0), far)
            most = max(most, far)
        return most + self.longest

    def _merge(self, ids: list[int]) -> list[int]:
        """The tokens of ``ids``: the pair of least rank first, the leftmost of equals."""
        n, ranks = len(ids), self.ranks
        if n < 2:
            return ids
        if n < 40:
            ids = list(ids)
            never, rank_of = 1 << 62, ranks.get
            pairs = [rank_of(x, never) for x in zip(ids, ids[1:])]
            while pairs:
                best = min(pairs)
                if best == never:
                    break
                at = pairs.index(best)
                ids[at : at + 2] = [best & 0xFFFFFFFF]
                del pairs[at]
                if at:
                    pairs[at - 1] = rank_of((ids[at - 1], ids[at]), never)
                if at < len(pairs):
                    pairs[at] = rank_of((ids[at], ids[at + 1]), never)
            return ids
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r >> 32, i, r & 0xFFFFFFFF, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(queue, (r >> 32, x, r & 0xFFFFFFFF, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_word(self, pieces):
        """Tokens of one word, given as byte strings in order; each is emitted once it is stable."""
        room = self.lookahead + BLOCK
        window: list[int] = []
        inner = self.inner
        held = b""
        for piece in pieces:
            if not piece:
                continue
            # The last byte of a word has its own symbol, so one byte is kept back.
            data, held = held + piece[:-1], piece[-1:]
            for i in range(0, len(data), BLOCK):
                window += [x for x in map(inner.__getitem__, data[i : i + BLOCK]) if x is not None]
                if len(window) >= room:
                    window = yield from self._stable(window)
        if held:
            x = self.last[held[0]]
            window += [] if x is None else [x]
        yield from self._merge(window)

    def encode_short(self, data: bytes) -> list[int]:
        """Tokens of a word that fits in a window."""
        if len(data) > BLOCK:
            return list(self.encode_word([data]))
        window = [self.inner[b] for b in data[:-1]]
        window.append(self.last[data[-1]])
        return self._merge([x for x in window if x is not None] if None in window else window)

    def _stable(self, window: list[int]):
        """Emit the tokens that end before the lookahead; give back the symbols after them."""
        limit, at = len(window) - self.lookahead, 0
        for token in self._merge(window):
            end = at + self.width[token]
            if end > limit:
                break
            yield token
            at = end
        return window[at:]


class Transducer:
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.merges = Merges(spec["model"])
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.folds = "Lowercase" in kinds
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        if not self.folds:
            raise ValueError("only vocabularies with word ends are read here")
        newer = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split())
        old = f"--[{newer}]"
        letter, digit = rf"[\p{{L}}{old}]", rf"[\p{{N}}{old}]"
        self.words = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[^{SPACE}{letter}{digit}]+")
        # The same where all characters are below U+0100, for speed.
        few = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
        self.latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{few}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t\n\x0b\x0c\r \x85\xa00-9\xb2\xb3\xb9\xbc-\xbe{few}]+")
        names = {v: k for k, v in self.merges.vocab.items()} | {v: k for k, v in self.added.items()}
        #: The UTF-8 of each token's name, which a vocabulary without a decoder joins by spaces.
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        byte_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        end = self.merges.end
        #: The bytes that each token stands for; a word's end stands for a space.
        self.raw = [self._bytes(names.get(i, ""), end, byte_of) for i in range(max(names) + 1)]
        self.ids = _Memory(self)

    def _bytes(self, name: str, end: str, byte_of: dict[str, bytes]) -> bytes:
        if name in self.added:
            return name.encode()
        closed = bool(end) and name.endswith(end)
        return b"".join(byte_of.get(c, b"") for c in (name[: -len(end)] if closed else name)) + b" " * closed

    @staticmethod
    def folded(text: str) -> str:
        """NFC, then each character lower-cased by itself: a final sigma is no exception."""
        if not text.isascii() and not _latin(text):  # what is below U+0100 is composed already
            text = (unicodedata.normalize if odd_marks().search(text) is None else library_nfc)("NFC", text)
            if text.isascii() or _ODD.search(text) is None:
                return text.lower()
            return "".join(NEW_CASES.get(c) or c.lower() for c in text)
        return text.lower()

    def remember(self, word: str) -> bytes:
        out = array("I", self.merges.encode_short(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self.ids) >= REMEMBERED:
                self.ids.clear()
            self.ids[word] = out
        return out

    def encode(self, text: str):
        """Ids as little-endian 32-bit integers, piece by piece.

        A piece is the tokens of some consecutive words, or one token of a word
        that is longer than what is read at a time.
        """
        at = 0
        for found in self.special.finditer(text) if self.special and any(x in text for x in self.added) else ():
            yield from self._plain(text[at : found.start()])
            token = self.added[found[0]]
            yield array("I", [token]).tobytes()
            at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str):
        at = 0
        while at < len(text):
            end = self._word_end(text, at)
            part = self.folded(text[at:end])
            at = end
            try:
                part.encode("latin-1")
                pattern = self.latin
            except UnicodeEncodeError:
                pattern = self.words
            if len(part) <= 2 * READ:
                words = pattern.findall(part)
                if words:
                    yield b"".join(map(self.ids.__getitem__, words))
                continue
            for found in pattern.finditer(part):
                low, high = found.span()
                if high - low <= READ:
                    yield self.remember(part[low:high])
                    continue
                for token in self.merges.encode_word(part[i : min(i + READ, high)].encode() for i in range(low, high, READ)):
                    yield array("I", [token]).tobytes()

    @staticmethod
    def _word_end(text: str, at: int) -> int:
        """Where a word ends, about ``READ`` characters after ``at``: nothing changes if the text is cut there."""
        low = at
        while low + READ < len(text):
            high = low + READ
            near = max(text.rfind(" ", low, high), text.rfind("\n", low, high))
            if near < 0:
                near = max(text.rfind(c, low, high) for c in SPACE)
            if near >= 0:
                return near + 1
            seams = [m.start() for m in _SEAM.finditer(text, max(low, at + 1), high)]
            if seams:
                return seams[-1]
            low = high
        return len(text)

    def decode(self, pieces):
        """The text that the library's decoder gives for ids (pieces as :meth:`encode` yields), piece by piece.

        A vocabulary without a decoder joins the names of its tokens by spaces.
        """

        def spelled():
            between = b""
            for ids in pieces:
                yield between + b" ".join(map(self.names.__getitem__, array("I", ids)))
                between = b" "

        return decode_bytes(spelled())

    def text_of(self, ids):
        """The text that ids stand for, piece by piece: an incremental decoder from bytes to characters.

        Bytes that begin a character wait for the rest of it; what never becomes
        a character is replaced.
        """
        return decode_bytes(self.raw[i] for i in ids)


class _Memory(dict):
    """The ids of the words seen lately; a word not seen is encoded."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word: str) -> bytes:
        return self.of.remember(word)


def decode_bytes(pieces):
    """Characters of UTF-8 pieces cut anywhere: a state machine that holds at most three bytes."""
    held = b""
    for piece in pieces:
        data = held + piece
        # Where an unfinished character may begin: a lead byte among the last three.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut = len(data) - back
                break
            if b < 0x80:
                break
        held = data[cut:]
        if cut:
            yield data[:cut].decode("utf-8", "replace")
    if held:
        yield held.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_OUT = "doc_id long, n_tokens long, ids binary, decoded string"


#: Bytes of ids and text that a worker gathers before it hands them on.
HELD = 8 << 20


def _digests(path: str, real: bool):
    """(doc_id, text, ...) in; the number of ids, then digests of ids and decoded text, or these themselves."""
    names = ("n_tokens", "ids", "decoded") if real else ("n_tokens", "ids_sha256", "decoded_sha256")
    kinds = (pa.int64(), pa.binary(), pa.string()) if real else (pa.int64(), pa.string(), pa.string())

    def run(batches):
        t = transducer(path)
        for batch in batches:
            rows: list[tuple] = []
            low, size = 0, 0

            def done(low, rows, batch=batch):
                part = batch.slice(low, len(rows))
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                return pa.RecordBatch.from_arrays([part.column(0), *made], [batch.schema.names[0], *names])

            for text in batch.column(1).to_pylist():
                n = 0
                ids, decoded = ([], []) if real else (hashlib.sha256(), hashlib.sha256())

                def kept(pieces, ids=ids):
                    nonlocal n
                    for blob in pieces:
                        n += len(blob) // 4
                        ids.append(blob) if real else ids.update(blob)
                        yield blob

                for part in t.decode(kept(t.encode(text or ""))):
                    decoded.append(part) if real else decoded.update(part.encode())
                rows.append((n, b"".join(ids), "".join(decoded)) if real else (n, ids.hexdigest(), decoded.hexdigest()))
                size += len(rows[-1][1]) + len(rows[-1][2])
                if size > HELD:
                    yield done(low, rows)
                    low, rows, size = low + len(rows), [], 0
            yield done(low, rows)

    return run


def encode_decode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit integers) and ``decoded`` of every row.

    Ids are those of the library with this file and no special tokens added;
    ``decoded`` is what its decoder gives for them: the tokens' names joined by
    a space, since the file names no decoder.  :meth:`Transducer.text_of` gives
    the text that ids stand for.

    Null and empty texts have no ids and decode to the empty text.  Null and
    repeated ids are carried as they are.  An empty table gives an empty
    result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_digests(path, True)), _OUT)


def encoded_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As :func:`encode_decode`, with the SHA-256 of ids and decoded text, which are never held whole."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_digests(path, False)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's columns but the text, and its tokens: number, ids, and the digests of ids and decoded text.

    Null and repeated ids are carried as they are; null and empty texts have
    no tokens.  Columns that have the names of the new ones give way to them.
    """
    small_batches(spark)
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "text")
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    out = rows.mapInArrow(lean(_digests(default_path(), True)), T.StructType([rows.schema.fields[0], *new]))
    return out.select("row.*", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
