"""Search of blocks of vectors with matrix products, in Arrow batches.

Rows are dealt to groups of bounded size by a hash of their ids; a task holds one group and streams the
queries, which travel once to each group. Products only select: a row whose approximate distance, give or
take the rounding error of a product, can be among the k best is measured again, component by
component from the left, so that distances do not depend on blocks or libraries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the vectors of a group, and numbers of a product at once.
GROUP_BYTES, AT_ONCE = 64 << 20, 1 << 22
#: Entries of the sparse rows of a group, and most columns of it that are multiplied as a dense matrix.
GROUP_ENTRIES, PACK_ENTRIES, DENSE = 1 << 22, 1 << 20, 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = np.asarray(column.flatten().cast(pa.float64())), np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


class Group:
    """Vectors of a group, their ids, squared lengths and rows by label."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: list[list[int]] | None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.squares = (self.vectors**2).sum(1)
        self.by: dict[int, np.ndarray] | None = None
        if labels is not None:
            owner = np.repeat(np.argsort(order), [len(x or ()) for x in labels])
            flat = np.array([y for x in labels for y in x or ()], np.int64)
            keys, at = np.unique(flat, return_inverse=True)
            self.by = {int(k): np.unique(owner[at == j]) for j, k in enumerate(keys)}

    def rows(self, need: list[int]) -> np.ndarray:
        """Rows that carry all the labels, from the rarest label on; none without labels."""
        lists = sorted((self.by.get(x, np.zeros(0, np.int64)) for x in set(need)), key=len)
        found = lists[0] if lists else np.zeros(0, np.int64)
        for x in lists[1:]:
            found = found[np.isin(found, x, assume_unique=True)]
        return found


def measure(query: np.ndarray, rows: np.ndarray, product: bool) -> np.ndarray:
    """Squared distances, or inner products, summed from the left."""
    if not rows.shape[1]:
        return np.zeros(len(rows))
    terms = rows * query if product else (rows - query) ** 2
    return np.add.accumulate(terms, axis=1)[:, -1]


def nearest(group: Group, query: np.ndarray, own: int | None, near: np.ndarray, rows: np.ndarray | None, k: int | None, radius: float | None, product: bool, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k best rows, or of those within the radius; near has approximate distances, smaller being better."""
    if own is not None:
        keep = (group.ids if rows is None else group.ids[rows]) != own
        near, rows = near[keep], np.flatnonzero(keep) if rows is None else rows[keep]
    bound = radius
    if radius is None:
        bound = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
    some = np.flatnonzero(near <= bound + slack)
    places = some if rows is None else rows[some]
    exact = measure(query, group.vectors[places], product)
    if radius is not None:
        inside = exact < radius
        return places[inside], exact[inside]
    best = np.lexsort((places, -exact if product else exact))[:k]
    return places[best], exact[best]


def search_blocks(queries: DataFrame, vectors: DataFrame, k: int | None = None, radius: float | None = None, product: bool = False, exclude_self: bool = False, kind: str = "double") -> DataFrame:
    """qid, id, dist: for each group and query the k best rows by (distance, id), or all rows nearer than the squared radius.

    queries (qid, qv[, qlabels]) against vectors (id, v[, labels]): with labels, only rows that carry all of
    a query's labels are searched. kind: double, or long for whole numbers, whose distances are exact below 2^53.
    """
    spark, filtered = queries.sparkSession, "qlabels" in queries.columns
    n, first = vectors.count(), vectors.select(F.size("v").alias("d")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * 8 * (first.d if first else 1) // GROUP_BYTES))
    parts = max(1, min(parts, n))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    tags = lambda name: F.col(name).cast("array<long>") if filtered else F.lit(None).cast("array<long>")
    rows = vectors.select(part.alias("part"), F.lit(False).alias("asks"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), tags("labels").alias("tags"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), F.col("qid").cast("long").alias("id"), F.col("qv").cast("array<double>").alias("v"), tags("qlabels").alias("tags"))
    met = rows.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("asks").select("asks", "id", "v", "tags")
    kinds = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            asks = batch.column(0)
            split = batch.num_rows - (asks.true_count or 0)
            if split:
                held.append(batch.slice(0, split))
            batch = batch.slice(split)
            if not batch.num_rows or not held:
                continue
            if group is None:
                table = pa.Table.from_batches(held)
                group = Group(np.asarray(table.column(1)), _matrix(table.column(2)), table.column(3).to_pylist() if filtered else None)
            wanted, qids = _matrix(pa.concat_arrays([batch.column(2)])), np.asarray(batch.column(1))
            need = batch.column(3).to_pylist() if filtered else None
            if wanted.shape[1] != group.vectors.shape[1]:
                raise ValueError("queries and vectors differ in length")
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            step = max(1, AT_ONCE // max(1, len(group.ids)))
            for low in range(0, len(qids), step):
                q = wanted[low : low + step]
                both = None if filtered else q @ group.vectors.T
                for i in range(len(q)):
                    among = group.rows(need[low + i] or []) if filtered else None
                    if filtered and not len(among):
                        continue
                    dots = both[i] if among is None else group.vectors[among] @ q[i]
                    squares = group.squares if among is None else group.squares[among]
                    size = float(q[i] @ q[i])
                    near = -dots if product else squares - 2 * dots + size
                    slack = 1e-12 * len(q[i]) * (size + float(squares.max()))
                    places, far = nearest(group, q[i], int(qids[low + i]) if exclude_self else None, near, among, k, radius, product, slack)
                    if len(places):
                        found.append((np.full(len(places), qids[low + i]), group.ids[places], far))
            if found:
                qid, ids, far = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids), pa.array(far.astype(np.int64) if kind == "long" else far, kinds)], names=["qid", "id", "dist"])

    return met.mapInArrow(run, f"qid long, id long, dist {'long' if kind == 'long' else 'double'}")


class SparseGroup:
    """Sparse rows of a group: frequent columns as a dense matrix, the others as postings."""

    def __init__(self, ids: np.ndarray, columns: pa.Array, codes: np.ndarray, values: np.ndarray):
        self.ids, at = np.unique(ids, return_inverse=True)
        at, self.columns = at.astype(np.int32), columns
        order = np.argsort(codes, kind="stable")
        self.rows, self.values = at[order], values[order]
        self.ends = np.cumsum(np.bincount(codes, minlength=len(self.columns)))
        sizes = np.diff(self.ends, prepend=0)
        often = np.argsort(-sizes, kind="stable")[:DENSE]
        often = often[sizes[often] * 64 > len(self.ids)]
        self.place = np.full(len(self.columns), -1)
        self.place[often] = np.arange(len(often))
        self.positive, self.largest = bool((values > 0).all()), float(np.abs(values.astype(float)).max())
        self.total = float(np.bincount(at, np.abs(values.astype(float))).max())
        self.dense: dict[type, np.ndarray] = {}

    def matrix(self, kind: type) -> np.ndarray:
        """Frequent columns of all rows; repeated entries add up."""
        if kind not in self.dense:
            self.dense = {kind: np.zeros((int((self.place >= 0).sum()), len(self.ids)), kind)}
            for c in np.flatnonzero(self.place >= 0):
                np.add.at(self.dense[kind][self.place[c]], self.rows[self.span(c)], self.values[self.span(c)].astype(kind))
        return self.dense[kind]

    def span(self, column: int) -> slice:
        return slice(self.ends[column - 1] if column else 0, self.ends[column])

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (columns of the group, values) ids and sums of the k largest inner products of rows with a common column."""
        whole = self.values.dtype.kind == "i"
        most = max((float(np.abs(v.astype(float)).max(initial=0)) for _, v in queries), default=0.0)
        heavy = max((float(np.abs(v.astype(float)).sum()) for _, v in queries), default=0.0)
        bound = min(most * self.total, heavy * self.largest)  # no partial sum is larger
        kind = float if not whole else np.float32 if bound < 1 << 24 else float if bound < 1 << 53 else np.int64
        frequent = self.matrix(kind)
        asked = np.zeros((len(queries), len(frequent)), kind)
        for i, (columns, values) in enumerate(queries):
            dense = self.place[columns] >= 0
            np.add.at(asked[i], self.place[columns[dense]], values[dense].astype(kind))
        products = asked @ frequent
        for sums, (columns, values) in zip(products, queries, strict=True):
            rare = self.place[columns] < 0
            spans = [self.span(c) for c in columns[rare]]
            if spans:
                at = np.concatenate([self.rows[x] for x in spans])
                terms = np.concatenate([self.values[x].astype(sums.dtype) * v for x, v in zip(spans, values[rare].astype(sums.dtype), strict=True)])
                if kind is np.int64:
                    np.add.at(sums, at, terms)
                else:
                    sums = sums.astype(float) + np.bincount(at, terms, len(sums))
            if self.positive and (values > 0).all():
                met = np.flatnonzero(sums > 0)
            else:
                touched = np.zeros(len(sums), bool)
                for c in columns:
                    touched[self.rows[self.span(c)]] = True
                met = np.flatnonzero(touched)
            if len(met) > k:
                met = met[sums[met] >= np.partition(sums[met], len(met) - k)[len(met) - k]]
            met = met[np.lexsort((met, -sums[met]))[:k]]
            yield self.ids[met], sums[met]


def _packer():
    """Rows (part, id, cols, vals) to (part, blob): compressed lists of many rows of a part."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        part = np.asarray(table.column(0))
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        for p, low, high in zip(found, starts, np.append(starts[1:], len(part)), strict=True):
            rows = table.take(order[low:high]).combine_chunks()
            cols, vals = (rows.column(c).chunk(0) for c in (2, 3))
            sizes = pc.list_value_length(cols)
            entries = pa.record_batch([pc.take(rows.column(1).chunk(0), pc.list_parent_indices(cols)), cols.flatten().dictionary_encode(), vals.flatten()], names=["id", "col", "val"])
            if not pc.list_value_length(vals).equals(sizes):
                raise ValueError("columns and values of a sparse vector differ in number")
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, entries.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(entries)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                held.append(batch.slice(low, 1024))
                n += len(held[-1].column(2).flatten())
                if n >= PACK_ENTRIES:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _unpacked(blobs: list[bytes]) -> pa.Table:
    """The entries (id, col, val) of blobs, with one dictionary of columns and without nulls."""
    table = pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in blobs).unify_dictionaries().combine_chunks()
    return table.filter(pc.and_(pc.is_valid(table.column(1)), pc.is_valid(table.column(2)))) if table.column(1).null_count or table.column(2).null_count else table


def sparse_blocks(queries: DataFrame, rows: DataFrame, k: int, entries: int | None = None) -> DataFrame:
    """qid, id, dist: for each query (qid, cols, vals) and group the rows (id, cols, vals) with the k largest inner products, of those with a common column.

    Rows are packed and dealt by a hash of their ids, packed queries travel once to each group, and products are summed
    where they arise: no pair is shuffled but the answers. Entries of equal ids and columns add up; whole numbers give
    exact sums. entries: about how many the rows have, for the number of groups; counted if not given.
    """
    spark = queries.sparkSession
    whole = all(dict(x.dtypes)["vals"] in ("array<int>", "array<bigint>") for x in (queries, rows))
    kind, dtype = ("long", np.int64) if whole else ("double", float)
    n = entries if entries is not None else rows.agg(F.sum(F.size("cols"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_ENTRIES))
    vector = lambda df, name, part: df.select(part.cast("int").alias("part"), F.col(name).cast("long").alias("id"), "cols", F.col("vals").cast(f"array<{kind}>").alias("vals"))
    pack = lambda df: df.where("id is not null and cols is not null and vals is not null").mapInArrow(_packer(), "part int, blob binary")
    once = queries.groupBy("qid").agg(F.flatten(F.collect_list("cols")).alias("cols"), F.flatten(F.collect_list("vals")).alias("vals"))  # a query's own entries
    dealt = pack(vector(rows, "id", F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(parts)))).withColumn("asks", F.lit(False))
    asked = pack(vector(once, "qid", F.lit(0))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(True))
    met = dealt.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("asks").select("asks", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        group = None
        for batch in batches:
            for asks, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not asks:
                    held.append(blob.as_py())
                    continue
                if group is None:
                    table = _unpacked(held) if held else None
                    held = []
                    if table is None or not table.num_rows:
                        return
                    coded = table.column(1).chunk(0)
                    group = SparseGroup(np.asarray(table.column(0)), coded.dictionary, np.asarray(coded.indices), np.asarray(table.column(2)).astype(dtype))
                    del table, coded
                yield from answers(_unpacked([blob.as_py()]), group)

    def answers(table: pa.Table, group: SparseGroup) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        order = np.argsort(np.asarray(table.column(0)), kind="stable")
        qids, values = np.asarray(table.column(0))[order], np.asarray(table.column(2)).astype(dtype)[order]
        coded = table.column(1).chunk(0)
        own = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=group.columns), -1))
        codes = own[np.asarray(coded.indices)][order]
        starts = np.flatnonzero(np.diff(qids, prepend=qids[0] - 1))
        spans = list(zip(starts, np.append(starts[1:], len(qids)), strict=True))
        step = max(1, AT_ONCE // len(group.ids))
        for low in range(0, len(spans), step):
            some = spans[low : low + step]
            wanted = [(codes[i:j][codes[i:j] >= 0], values[i:j][codes[i:j] >= 0]) for i, j in some]
            found = [(np.full(len(ids), qids[i]), ids, far) for (i, _), (ids, far) in zip(some, group.best(wanted, k), strict=True)]
            qid, ids, far = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids), pa.array(far.astype(dtype))], names=["qid", "id", "dist"])

    return met.mapInArrow(run, f"qid long, id long, dist {kind}")
