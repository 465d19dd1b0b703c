"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the ranks of a word's adjacent pairs, each with its position; the root is
the leftmost pair of the lowest rank. A merge updates three leaves, so a word of n bytes takes
O(n log n) steps whatever its length. Words are cut out of whole texts as the vocabulary's own
pre-tokenizer does; results of short words are kept in a cache of bounded size.

Two kinds of vocabulary files (JSON of the tokenizers library) are understood: byte-level BPE, and
word BPE, which lower-cases, drops white space and marks word ends. Strings of special tokens in a
text become their ids, as the library does by default.

Null texts count as empty and have no tokens; the ids and the decoded text are then empty too.
Repeated rows and repeated ids of documents are encoded row by row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept by a Python worker in each of two generations, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 250_000, 48
_NONE = 1 << 62
#: White space, and the patterns of the two pre-tokenizers.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge(ids: list[int], ranks: dict[int, int]) -> list[int]:
    """Merges pairs, the lowest rank and then the leftmost first, until no pair has a rank.

    ranks: pair (left << 20 | right) to rank << 20 | merged id.
    """
    n = len(ids)
    if n < 2:
        return ids
    get, none = ranks.get, _NONE
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * size
    some = False
    for i in range(n - 1):
        v = get(ids[i] << 20 | ids[i + 1])
        if v is None:
            tree.append(none)
        else:
            tree.append((v >> 20) << 32 | i)
            some = True
    if not some:
        return ids
    tree += [none] * (2 * size - len(tree))
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before, ids = list(range(1, n + 1)), list(range(-1, n)), ids.copy()
    while (root := tree[1]) != none:
        i = root & 0xFFFFFFFF
        j = after[i]
        ids[i] = get(ids[i] << 20 | ids[j]) & 0xFFFFF
        ids[j] = -1
        after[i] = k = after[j]
        new = none
        if k < n:
            before[k] = i
            if j < n - 1 and tree[size + j] != none:  # the right part's own pair is gone
                leaf = size + j
                tree[leaf] = none
                while leaf > 1:
                    a, b = tree[leaf], tree[leaf ^ 1]
                    leaf >>= 1
                    if b < a:
                        a = b
                    if tree[leaf] == a:
                        break
                    tree[leaf] = a
            v = get(ids[i] << 20 | ids[k])
            if v is not None:
                new = (v >> 20) << 32 | i
        leaf = size + i
        tree[leaf] = new
        while leaf > 1:
            a, b = tree[leaf], tree[leaf ^ 1]
            leaf >>= 1
            if b < a:
                a = b
            if tree[leaf] == a:
                break
            tree[leaf] = a
        h = before[i]
        if h >= 0:
            v = get(ids[h] << 20 | ids[i])
            new = none if v is None else (v >> 20) << 32 | h
            leaf = size + h
            if tree[leaf] != new:
                tree[leaf] = new
                while leaf > 1:
                    a, b = tree[leaf], tree[leaf ^ 1]
                    leaf >>= 1
                    if b < a:
                        a = b
                    if tree[leaf] == a:
                        break
                    tree[leaf] = a
    return [x for x in ids if x >= 0]


class Vocabulary:
    """A vocabulary file, its pre-tokenizer and the cache of its words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.word_end = spec["model"].get("end_of_word_suffix") or ""
        self.by_word = bool(self.word_end)
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + self.word_end] for x in letters]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.bytes_of = {x: i for i, x in enumerate(letters)}
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces = regex.compile((WORD_PATTERN if self.by_word else BYTE_PATTERN).replace(r"\s", WHITE).replace(r"\S", f"[^{WHITE}]").replace(f"{WHITE}+(?", f"[{WHITE}]+(?").replace(f"|{WHITE}+", f"|[{WHITE}]+"))
        self.white = regex.compile(f"[{WHITE}]+")
        self.odd = regex.compile(f"[\\x1c-\\x1f]" if self.by_word else f"[{WHITE}] (?:[{WHITE}]|$)")
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def word(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return merge(ids, self.ranks)

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The ids, as little-endian 32-bit integers, and the joined token strings of a run of text."""
        got = self.old.get(chunk)
        if got is None:
            pieces = [chunk] if chunk.isalpha() else self.pieces.findall(chunk)
            if len(pieces) > 1 and self.by_word:  # the words in it may be known
                parts = [self.young.get(x) or self.chunk(x) for x in pieces]
                got = b"".join([a for a, _ in parts]), " ".join([b for _, b in parts])
            else:
                ids = [i for piece in pieces for i in self.word(piece)]
                got = array("I", ids).tobytes(), self.text(ids)
            if len(chunk) > CACHE_CHARS:
                return got
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[chunk] = got
        return got

    def text(self, ids) -> str:
        """The decoded text of ids: token strings with blanks between (word BPE) or the bytes they stand for."""
        strings = self.strings
        if self.by_word:
            return " ".join([strings[i] for i in ids])
        known, out = self.bytes_of, bytearray()
        for i in ids:
            t = strings[i]
            out += t.encode() if t in self.special else bytes(known[c] for c in t)
        return out.decode("utf-8", errors="replace")

    def chunks(self, segment: str) -> list[str]:
        """Runs of text, cut where no token can cross."""
        if self.by_word:
            if not segment.isascii():
                segment = unicodedata.normalize("NFC", segment).replace("Σ", "σ")  # no final sigma
            segment = segment.lower()
            return segment.split() if not self.odd.search(segment) else [x for x in self.white.split(segment) if x]
        if self.odd.search(segment):
            return self.pieces.findall(segment)
        head, *rest = segment.split(" ")
        return ([head] if head else []) + [" " + x for x in rest]

    def encode(self, text: str) -> tuple[bytes, list[str]]:
        """The ids of a text as bytes, and the token strings of its parts (for word BPE joined with blanks)."""
        parts: list[tuple[bytes, str]] = []
        segments = self.specials.split(text) if self.specials and any(x in text for x in self.special) else [text]
        for k, segment in enumerate(segments):
            if k % 2:
                parts.append((array("I", [self.special[segment]]).tobytes(), segment))
            elif segment:
                young, slow = self.young.get, self.chunk
                parts += [young(x) or slow(x) for x in self.chunks(segment)]
                if self.young is not young.__self__:
                    young = self.young.get
        return b"".join([a for a, _ in parts]), [b for _, b in parts]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int> of every whole text."""
    schema = docs.select(id_col).withColumn("ids", F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = [array("I", vocab.encode(t or "")[0]).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text that the ids stand for; null ids count as none."""
    schema = encoded.select(id_col).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocab.text(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again by word BPE."""
    schema = docs.select(id_col).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, sha = vocabulary(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for value in batch.column(1):
                ids, strings = vocab.encode(value.as_py() or "")
                decoded = " ".join(strings) if vocab.by_word else vocab.text(memoryview(ids).cast("I"))
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
