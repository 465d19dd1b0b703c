"""Quality rules: base counts, and the divergence of a text's histograms from language references.

Two histograms of a text, of character classes and of common words, are compared with those of every
language by the Jensen-Shannon distance (base 2, so from 0 to 1); the nearest language counts. A text
is rejected if it fails the base rules or if a distance exceeds its limit. Texts with fewer than
MIN_CHARS characters or MIN_WORDS words aren't judged by the respective histogram.

References are fitted on all documents of every language; a language's common words are the COMMON most
frequent of them. A fitting task passes its counts on when it holds FIT_WORDS of them.
Without any reference only the base rules hold.

Words are [^\\x20\\x09-\\x0D]+ of the whole text. Null texts have no words and so fail. Rows are judged
one by one, so repeated rows and ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut

FIT_WORDS, COMMON, MIN_CHARS, MIN_WORDS, CHAR_LIMIT, WORD_LIMIT = 1 << 18, 100, 200, 100, 0.28, 0.41
#: The contract's symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "digit", "space", "mark", "symbol", "other")
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASS:
        by = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 4, "Zp": 4, "Mn": 2, "Mc": 2, "Me": 2, "Pd": 5, "Ps": 5, "Pe": 5, "Pi": 5, "Pf": 5, "Po": 5, "Pc": 6, "Sm": 6, "Sc": 6, "Sk": 6, "So": 6}
        table = np.array([by.get(unicodedata.category(chr(i)), 7) for i in range(0x110000)], np.uint8)
        table[9:14] = 4
        table[[ord(c) for c in SYMBOLS]] = 6
        _CLASS.append(table)
    return _CLASS[0]


def class_counts(text: str) -> np.ndarray:
    return np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(CLASSES))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct < 1 << 20:
        keys = pairs[:-1] * distinct + ids[2:]
    else:
        keys = np.unique(pairs, return_inverse=True)[1][:-1] * distinct + ids[2:]
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[dict[bytes, int], np.ndarray, tuple[int, int, int, int, int]]:
    """Word codes, the words' codes in order, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    codes: dict[bytes, int] = {}
    put = codes.setdefault
    ids = np.array([put(w, len(codes)) for w in words], np.int64)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    return codes, ids, (len(words), chars, sum(text.count(c) for c in SYMBOLS), sum(lines.values()) - len(lines), repeated_words(ids, len(codes)))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance, base 2, of two histograms that needn't be scaled."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() / 2 + np.where(q > 0, q * np.log2(q / m), 0).sum() / 2
    return float(np.sqrt(max(0.0, d)))


class References:
    """For each language its common words and both histograms."""

    def __init__(self, classes: dict[str, list[int]], words: dict[str, list[tuple[str, int]]], totals: dict[str, int]):
        self.names = sorted(n for n in classes if sum(classes[n]) and totals.get(n))
        self.classes = [np.array(classes[n], float) for n in self.names]
        self.common = [[w.encode() for w, _ in words[n]] for n in self.names]
        self.words = [np.array([*(c for _, c in words[n]), totals[n] - sum(c for _, c in words[n])], float) for n in self.names]

    def distances(self, text: str, codes: dict[bytes, int], ids: np.ndarray) -> tuple[float | None, float | None]:
        """The least distance by character classes and by common words; None where the text is too short."""
        by_char = by_word = None
        if self.names and len(text) >= MIN_CHARS:
            have = class_counts(text).astype(float)
            by_char = min(distance(have, r) for r in self.classes)
        if self.names and len(ids) >= MIN_WORDS:
            n = np.bincount(ids, minlength=len(codes))
            by_word = 1.0
            for common, r in zip(self.common, self.words, strict=True):
                have = [n[codes[w]] if w in codes else 0 for w in common]
                by_word = min(by_word, distance(np.array([*have, len(ids) - sum(have)], float), r))
        return by_char, by_word


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """References from every document whose text and language are known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([not isinstance(k, bytes) for k in own]), pa.array([k if isinstance(k, str) else k.decode() for k in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "is_class", "key", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, Counter())
                own.update(text.as_py().encode("utf-8").split())
                own.update({c: int(n) for c, n in zip(CLASSES, class_counts(text.as_py()), strict=True)})
                if sum(map(len, sums.values())) >= FIT_WORDS:
                    yield from flush()
        yield from flush()

    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = cut(some.mapInArrow(count, "lang string, is_class boolean, key string, n long").groupBy("lang", "is_class", "key").agg(F.sum("n").alias("n")), "counts")
    classes: dict[str, list[int]] = {}
    for r in counts.where("is_class").collect():  # a row for each language and class
        classes.setdefault(r.lang, [0] * len(CLASSES))[CLASSES.index(r.key)] = r.n
    totals = {r.lang: r.n for r in counts.where("not is_class").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    words = {lang: [(r.key, r.n) for r in counts.where(~F.col("is_class") & (F.col("lang") == lang)).orderBy(F.desc("n"), "key").limit(COMMON).collect()] for lang in totals}
    return References(classes, words, totals)


def judge(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns (doc_id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    Columns to keep that are named like a new one are refused; a struct of them keeps any names.
    """
    columns = columns or [id_col]
    new = {c: F.lit(0).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {c: F.lit(True) for c in ("base_failed", "kept")} | {c: F.lit(0.0) for c in ("char_distance", "word_distance")}
    if {c.lower() for c in columns} & set(new):
        raise ValueError(f"columns may not be named {', '.join(new)}")
    schema = docs.select(*columns).withColumns(new).schema
    for field in schema.fields:
        field.nullable = True
    sent, names = docs.sparkSession.sparkContext.broadcast(references), [*columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or ""
                codes, ids, counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                by_char, by_word = sent.value.distances(text, codes, ids)
                kept = not failed and (by_char or 0) <= CHAR_LIMIT and (by_word or 0) <= WORD_LIMIT
                rows.append((*counts, failed, kept, by_char, by_word))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 9, kinds, strict=True)]], names=names)

    return docs.select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
