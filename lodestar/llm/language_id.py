"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter: every slot holds a mask with a bit for each language, in as many 64-bit words
as they need. An n-gram sets its
languages' bits in HASHES slots; the AND of its slots returns all languages that contain it at once.
For a text, the hits of each language are counted over all its character 3- and 4-grams, corrected
for the language's share of false positives, and the most hits decide (ties: the first by name).

Fitting takes a bounded sample of every language: about TRAIN_DOCS whole documents, picked by a hash,
and keeps at most GRAMS n-grams of a language. An n-gram belongs to a
language if it occurs at least twice in its sample and at least a tenth as often as in the language
where it is most frequent. Prediction reads whole texts and nothing but texts.

Null texts and texts without letters get "und" with score 0, as does everything if nothing could be
learned. Rows are judged one by one, so repeated rows and ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, sampled

TRAIN_DOCS, GRAMS, HASHES, SLOTS = 2000, 20_000, 3, 1 << 18
#: Code points read at once; longer texts are read in steps, whose arrays fit a core's cache.
STEP = 1 << 16
#: N-grams that a task of the fitting holds unsummed; beyond that it passes its counts on.
HELD = 1 << 20
_LETTERS: list[np.ndarray] = []
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two blanks, with blanks for all that aren't letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTERS[0][points], points, np.uint32(32))


def grams(points: np.ndarray, starts: int | None = None) -> np.ndarray:
    """64-bit hashes of the 3- and 4-grams that hold a letter; only of those that begin at the first places, if starts is given."""
    x, out = points.astype(np.uint64), []
    for n in (3, 4):
        if len(x) < n:
            continue
        m = min(len(x) - n + 1, starts or len(x))
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for j in range(n):
            part = x[j : j + m]
            h = (h ^ part) * _MIX[0]
            h ^= h >> np.uint64(29)
            some |= points[j : j + m] != 32
        out.append(h[some])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def steps(points: np.ndarray) -> Iterator[np.ndarray]:
    """The grams of all points; each is in one step."""
    for at in range(0, max(1, len(points) - 2), STEP):
        yield grams(points[at : at + STEP + 3], STEP)


def slots(hashes: np.ndarray, j: int) -> np.ndarray:
    h = hashes * _MIX[j % 3] + np.uint64(j + 1)
    return ((h ^ (h >> np.uint64(31))) * _MIX[(j + 1) % 3] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Filter:
    """The filter: names of languages, a mask for each slot, and each language's rate of false positives."""

    def __init__(self, known: dict[str, np.ndarray]):
        self.names = sorted(known)
        self.masks = np.zeros((-(-len(self.names) // 64), SLOTS), np.uint64)
        for bit, name in enumerate(self.names):
            for j in range(HASHES):
                at = np.unique(slots(known[name], j))
                self.masks[bit // 64, at] |= np.uint64(1 << bit % 64)
        fill = self.counts(self.masks) / SLOTS
        self.wrong = np.minimum(fill**HASHES, 0.999)

    def counts(self, masks: np.ndarray) -> np.ndarray:
        """How often each language's bit is set."""
        return np.array([np.count_nonzero(masks[b // 64] & np.uint64(1 << b % 64)) for b in range(len(self.names))], float)

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """The mask [word, n-gram] of all languages that hold each n-gram."""
        masks = self.masks[:, slots(hashes, 0)]
        for j in range(1, HASHES):
            masks &= self.masks[:, slots(hashes, j)]
        return masks

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters_only(text or "")
        if not self.names or not (points != 32).any():
            return "und", 0.0
        hits, n = np.zeros(len(self.names)), 0
        for part in steps(points):
            masks = self.languages(part)
            n += len(part)
            hits += self.counts(masks)
        right = np.maximum(hits - n * self.wrong, 0) / (1 - self.wrong)
        best = int(np.argmax(right))
        return self.names[best], float(min(1.0, right[best] / n))


def train(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> Filter:
    """The filter learned from the text and language of a bounded sample of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def counted(lang: str) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(parts.pop(lang)), return_counts=True)
            del sizes[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in steps(letters_only(text.as_py())):
                    parts.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sum(sizes.values()) >= HELD:
                        yield counted(max(sizes, key=sizes.get))
        for lang in list(parts):
            yield counted(lang)

    some = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    picked = sampled(some, "lang", TRAIN_DOCS, "id").select("lang", "text")
    counts = cut(picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1"), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = [r.lang for r in totals.select("lang").collect()]
    if not names:
        return Filter({})
    most = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate", "n")).alias("each"))
    kept = cut(most.select("gram", "most", F.explode("each").alias("x")).where("x.rate >= 0.1 * most").select("gram", "x.lang", "x.n"), "kept")
    known = {}
    for lang in names:
        table = kept.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(GRAMS).select("gram").toArrow()
        known[lang] = np.asarray(table.column("gram").combine_chunks()).astype(np.int64).view(np.uint64)
    return Filter(known)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: Filter, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs, lang_pred and score of every whole text.

    Columns to keep that are named like a new one are refused; a struct of them keeps any names.
    """
    if {c.lower() for c in columns} & {"lang_pred", "score"}:
        raise ValueError("columns may not be named lang_pred or score")
    schema = docs.select(*columns).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], names=[*columns, "lang_pred", "score"])

    return docs.select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return identify(docs.withColumn("held_out", held_out(id_col)), model, [id_col, "held_out"], text_col)
