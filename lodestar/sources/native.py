"""Native files of vector search as tables: dense vectors, sparse matrices, results, graphs, lists.

Readers are Python data sources whose partitions are row ranges, so that a file of any size is read in
parallel; files are opened through pyarrow, by path or URI. Ids are positions. start and limit keep a range of
the rows and are applied before anything is read. Writers encode rows in the order of their ids in Arrow
batches on the executors; the encoded pieces stream through the driver one by one, because these formats
are single files with a count in front.

Layouts (little-endian):
  fbin, u8bin, i8bin, ibin   uint32 n, uint32 d, n * d elements
  fvecs, bvecs, ivecs        per row int32 d, d elements
  spmat, spbit               int64 rows, cols, nnz; int64 indptr[rows + 1]; int32 indices; float32 values (not spbit)
  knn                        uint32 n, k; int32 ids, float32 distances
  pairs                      per place int32 id, float32 distance; dim places a query
  range                      int32 n, total; int32 counts; int32 ids; float32 distances
  graph                      int64 row pointers in .vertex.bin, uint32 targets in .edge.bin, text in .meta.txt;
                             with labels uint8 in .vlabel.bin and int32 in .elabel.bin
  fixed                      a graph: int32 n, largest degree; int32 degrees; int32 targets
  lists                      uint64 n; float32 centroids n * dim; int32 starts[n + 1]; int32 members
  uint8, int32               elements only
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.operators.prep import indptr

BIN = {"fbin": "<f4", "u8bin": "u1", "i8bin": "i1", "ibin": "<i4"}
VECS = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
FLAT = {"uint8": "u1", "int32": "<i4"}
PAIR = np.dtype([("id", "<i4"), ("dist", "<f4")])
ROWS = 1 << 16


def _open(path: str):
    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return fs.LocalFileSystem().open_input_file(path)


def _array(f, start: int, count: int, kind: str) -> np.ndarray:
    f.seek(start)
    data = f.read(count * np.dtype(kind).itemsize)
    if len(data) != count * np.dtype(kind).itemsize:
        raise ValueError("the file is shorter than its header says")
    return np.frombuffer(data, kind)


def _create(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def read_bytes(path: str, start: int = 0, end: int = 0, null_terminated: bool = False) -> bytes:
    """Bytes start to end of a file (to its end, if end is 0 or beyond it), with a zero byte after them if asked."""
    with _open(path) as f:
        size = f.size()
        start = min(start, size)
        f.seek(start)
        return f.read(max(0, (min(end, size) if end else size) - start)) + b"\0" * null_terminated


def exists(path: str) -> bool:
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def write_bytes(data: bytes, path: str) -> None:
    with _create(path) as f:
        f.write(data)


class _Rows(InputPartition):
    """Rows low to high; before: entries of the rows before low, where only counts tell."""

    def __init__(self, low: int, high: int, before: int = 0):
        self.low, self.high, self.before = low, high, before


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.second, self.third = options["path"], options["kind"], options.get("second"), options.get("third")
        self.step, self.start, self.limit, self.dim = int(options.get("rows", ROWS)), int(options.get("start", 0)), int(options.get("limit", 1 << 62)), int(options.get("dim", 0))

    def shape(self) -> tuple[int, int]:
        """Rows and, for dense files, the dimension."""
        with _open(self.path) as f:
            if self.kind in BIN or self.kind == "knn":
                n, d = struct.unpack("<II", f.read(8))
            elif self.kind in VECS:
                d = struct.unpack("<i", f.read(4))[0] if f.size() else 0
                n = f.size() // (4 + d * np.dtype(VECS[self.kind]).itemsize)
            elif self.kind in ("spmat", "spbit"):
                n, d, nnz = struct.unpack("<qqq", f.read(24))
                if nnz != _array(f, 24 + 8 * n, 1, "<i8")[0]:
                    raise ValueError("the row pointers do not end at the number of entries")
            elif self.kind in ("range", "fixed"):
                n, d = struct.unpack("<ii", f.read(8))
            elif self.kind == "pairs":
                n, d = f.size() // (8 * self.dim), self.dim
            elif self.kind == "lists":
                n, d = struct.unpack("<Q", f.read(8))[0], self.dim
            elif self.kind in FLAT:
                n, d = f.size() // np.dtype(FLAT[self.kind]).itemsize, 0
            else:
                n, d = f.size() // 8 - 1, 0
        return n, d

    def partitions(self) -> list[_Rows]:
        n = self.shape()[0]
        low, high = min(self.start, n), min(n, self.start + self.limit)
        parts = [_Rows(a, min(high, a + self.step)) for a in range(low, high, self.step)] or [_Rows(0, 0)]
        if self.kind in ("range", "fixed"):  # one pass over the counts, a step at a time
            before, at = 0, 0
            with _open(self.path) as f:
                for p in parts:
                    while at < p.low:
                        m = min(ROWS, p.low - at)
                        before, at = before + int(_array(f, 8 + 4 * at, m, "<i4").sum()), at + m
                    p.before = before
        return parts

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        low, high = part.low, part.high
        m = high - low
        if m <= 0:
            return
        n, d = self.shape()
        ids = np.arange(low, high, dtype=np.int64)
        with _open(self.path) as f:
            if self.kind in BIN or self.kind in VECS:
                if self.kind in BIN:
                    kind = BIN[self.kind]
                    flat = _array(f, 8 + low * d * np.dtype(kind).itemsize, m * d, kind)
                else:
                    kind = VECS[self.kind]
                    size = 4 + d * np.dtype(kind).itemsize
                    flat = _array(f, low * size, m * size, "u1").reshape(m, size)[:, 4:].copy().view(kind).ravel()
                values = pa.array(flat.astype(np.float32 if kind == "<f4" else np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * d, d, dtype=np.int32) if d else np.zeros(m + 1, np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "v"])
            elif self.kind in ("spmat", "spbit"):
                ptr = _array(f, 24 + 8 * low, m + 1, "<i8")
                base, total = 24 + 8 * (n + 1), int(_array(f, 24 + 8 * n, 1, "<i8")[0])
                count = int(ptr[-1] - ptr[0])
                cols = _array(f, base + 4 * int(ptr[0]), count, "<i4")
                if count and (cols.min() < 0 or cols.max() >= d):
                    raise ValueError("a column outside the matrix")
                values = _array(f, base + 4 * total + 4 * int(ptr[0]), count, "<f4") if self.kind == "spmat" else np.ones(count, np.float32)
                rows = np.repeat(ids, np.diff(ptr))
                order = np.lexsort((cols, rows))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols[order].astype(np.int64)), pa.array(values[order])], names=["row", "col", "val"])
            elif self.kind == "knn":
                found = _array(f, 8 + 4 * low * d, m * d, "<i4")
                far = _array(f, 8 + 4 * n * d + 4 * low * d, m * d, "<f4")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, d)), pa.array(np.tile(np.arange(1, d + 1), m)), pa.array(found.astype(np.int64)), pa.array(far)], names=["qid", "rank", "id", "dist"])
            elif self.kind == "pairs":
                found = _array(f, 8 * low * d, m * d, PAIR)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, d)), pa.array(np.tile(np.arange(1, d + 1), m)), pa.array(found["id"].astype(np.int64)), pa.array(found["dist"].copy())], names=["qid", "rank", "id", "dist"])
            elif self.kind == "range":
                start, own = part.before, _array(f, 8 + 4 * low, m, "<i4")
                found = _array(f, 8 + 4 * n + 4 * start, int(own.sum()), "<i4")
                far = _array(f, 8 + 4 * n + 4 * d + 4 * start, int(own.sum()), "<f4")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, own)), pa.array(found.astype(np.int64)), pa.array(far)], names=["qid", "id", "dist"])
            elif self.kind == "fixed":
                own = _array(f, 8 + 4 * low, m, "<i4")
                targets = _array(f, 8 + 4 * n + 4 * part.before, int(own.sum()), "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, own)), pa.array(targets.astype(np.int64))], names=["src", "dst"])
            elif self.kind == "lists":
                base = 8 + 4 * n * d
                ptr = _array(f, base + 4 * low, m + 1, "<i4").astype(np.int64)
                members = _array(f, base + 4 * (n + 1) + 4 * int(ptr[0]), int(ptr[-1] - ptr[0]), "<i4")
                centroids = _array(f, 8 + 4 * low * d, m * d, "<f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * d), pa.array(centroids))
                lists = pa.ListArray.from_arrays(pa.array((ptr - ptr[0]).astype(np.int32)), pa.array(members.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vectors, lists], names=["cid", "cv", "ids"])
            elif self.kind in FLAT:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_array(f, low * np.dtype(FLAT[self.kind]).itemsize, m, FLAT[self.kind]).astype(np.int64))], names=["id", "x"])
            else:
                ptr = _array(f, 8 * low, m + 1, "<i8")
                with _open(self.second) as g:
                    targets = _array(g, 4 * int(ptr[0]), int(ptr[-1] - ptr[0]), "<u4")
                columns = [pa.array(np.repeat(ids, np.diff(ptr))), pa.array(targets.astype(np.int64))]
                if self.third:
                    with _open(self.third) as g:
                        columns.append(pa.array(_array(g, 4 * int(ptr[0]), int(ptr[-1] - ptr[0]), "<i4").astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", "label"][: len(columns)])


class NativeSource(DataSource):
    """Format "native" with the options path, kind and, optionally, start, limit, rows (a partition), second and third (a graph's edges and their labels), dim (of lists, or places a query of pairs)."""

    @classmethod
    def name(cls) -> str:
        return "native"

    def schema(self) -> str:
        kind = self.options["kind"]
        if kind in ("fbin", "fvecs"):
            return "id long, v array<float>"
        if kind in BIN or kind in VECS:
            return "id long, v array<int>"
        if kind in FLAT:
            return "id long, x long"
        if kind == "graph" and self.options.get("third"):
            return "src long, dst long, label long"
        return {"fixed": "src long, dst long", "lists": "cid long, cv array<float>, ids array<long>", "spmat": "row long, col long, val float", "spbit": "row long, col long, val float", "knn": "qid long, rank long, id long, dist float", "pairs": "qid long, rank long, id long, dist float", "range": "qid long, id long, dist float", "graph": "src long, dst long"}[kind]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, kind: str, limit: int | None = None, start: int = 0, **options) -> DataFrame:
    """The file as a table, from row start on, limit rows at most; a graph's path is that of its .vertex.bin without the ending."""
    spark.dataSource.register(NativeSource)
    reader = spark.read.format("native").option("kind", kind).option("path", f"{path}.vertex.bin" if kind == "graph" else path)
    if kind == "graph":
        reader = reader.option("second", f"{path}.edge.bin")
    if limit is not None:
        reader = reader.option("limit", str(limit))
    if start:
        reader = reader.option("start", str(start))
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


_META = ("vertices", "edges", "vertex_bytes", "edge_bytes", "vertex_label_bytes", "edge_label_bytes", "max_degree", "features", "vertex_classes", "edge_classes")


def read_meta(path: str) -> dict[str, int]:
    """The numbers of a graph's .meta.txt, by name."""
    return dict(zip(_META, map(int, read_bytes(f"{path}.meta.txt").split()), strict=False))


def read_labelled_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, label) of the vertices and (src, dst, label) of the edges."""
    spark.dataSource.register(NativeSource)
    vertices = read(spark, f"{path}.vlabel.bin", "uint8").withColumnRenamed("x", "label")
    return vertices, read(spark, path, "graph", third=f"{path}.elabel.bin")


def _pieces(ordered: DataFrame, column: str, element: str, head: str | None = None, size: int | None = None) -> Iterator[bytes]:
    """The column's numbers, or lists of size numbers each (headed by their length, if asked), encoded batch by batch on the executors, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            if size is None:
                data = np.asarray(values).astype(element).tobytes()
            else:
                if any(n != size for n in values.value_lengths().to_pylist()):
                    raise ValueError("vectors differ in length")
                table = np.asarray(values.flatten()).astype(element).reshape(len(values), size)
                if head:
                    lengths = np.full((len(values), 1), size, head).view(np.uint8)
                    table = np.concatenate([lengths, table.view(np.uint8).reshape(len(values), -1)], axis=1)
                data = table.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    for row in ordered.select(column).mapInArrow(run, "data binary").toLocalIterator():
        yield bytes(row.data)


def write_vectors(rows: DataFrame, path: str, kind: str) -> None:
    """(id, v) as a dense file of any kind, in the order of ids."""
    element, n, first = BIN.get(kind) or VECS[kind], rows.count(), rows.select("v").head()
    d = len(first.v) if first else 0
    with _create(path) as f:
        if kind in BIN:
            f.write(struct.pack("<II", n, d))
        for data in _pieces(rows.orderBy("id"), "v", element, "<i4" if kind in VECS else None, d):
            f.write(data)


def _write_pointers(f, entries: DataFrame, rows: int) -> None:
    """int64 starts of rows + 1 rows of entries (row, ...)."""
    for data in _pieces(indptr(entries.select("row", F.lit(0).alias("col")), rows).orderBy("row"), "start", "<i8"):
        f.write(data)


def write_matrix(entries: DataFrame, path: str, rows: int, cols: int, values: bool = True) -> None:
    """(row, col[, val]) as spmat, values being ones where there is no val, or as spbit without values."""
    ordered = entries.orderBy("row", "col")
    with _create(path) as f:
        f.write(struct.pack("<qqq", rows, cols, entries.count()))
        _write_pointers(f, entries, rows)
        for data in _pieces(ordered, "col", "<i4"):
            f.write(data)
        if values:
            for data in _pieces(ordered if "val" in entries.columns else ordered.withColumn("val", F.lit(1.0)), "val", "<f4"):
                f.write(data)


def write_graph(edges: DataFrame, path: str, vertices: int, labels: DataFrame | None = None) -> None:
    """(src, dst[, label]) as .meta.txt, .vertex.bin, .edge.bin and, if edges have labels, .elabel.bin; labels (id, label) of all vertices as .vlabel.bin."""
    ordered, labelled = edges.orderBy("src", "dst"), "label" in edges.columns
    with _create(f"{path}.edge.bin") as f:
        for data in _pieces(ordered, "dst", "<u4"):
            f.write(data)
    with _create(f"{path}.vertex.bin") as f:
        _write_pointers(f, edges.select(F.col("src").alias("row")), vertices)
    if labelled:
        with _create(f"{path}.elabel.bin") as f:
            for data in _pieces(ordered, "label", "<i4"):
                f.write(data)
    if labels is not None:
        with _create(f"{path}.vlabel.bin") as f:
            for data in _pieces(labels.orderBy("id"), "label", "u1"):
                f.write(data)
    most = edges.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    classes = [labels.select("label").distinct().count() if labels is not None else 0, edges.select("label").distinct().count() if labelled else 0]
    with _create(f"{path}.meta.txt") as f:
        f.write(("\n".join(map(str, (vertices, edges.count(), "4 8 1 4", most, 0, *classes))) + "\n").encode())


def _placed(results: DataFrame, queries: int, k: int) -> DataFrame:
    """k places for each query, in order; missing ones have id -1 and distance 0."""
    places = results.sparkSession.range(queries).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    found = results.select("qid", "rank", F.col("id").alias("found"), "dist")
    return places.join(found, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("found", F.lit(-1)).alias("id"), F.coalesce("dist", F.lit(0.0)).alias("dist")).orderBy("qid", "rank")


def write_knn(results: DataFrame, path: str, queries: int, k: int) -> None:
    """(qid, rank, id, dist) with rank from 1 as a knn file; missing places have id -1 and distance 0."""
    ordered = _placed(results, queries, k)
    with _create(path) as f:
        f.write(struct.pack("<II", queries, k))
        for column, element in (("id", "<i4"), ("dist", "<f4")):
            for data in _pieces(ordered, column, element):
                f.write(data)


def write_pairs(results: DataFrame, path: str, queries: int, k: int) -> None:
    """(qid, rank, id, dist) as pairs of an id and a distance, k a query, without a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.empty(batch.num_rows, PAIR)
            pairs["id"], pairs["dist"] = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], names=["data"])

    with _create(path) as f:
        for row in _placed(results, queries, k).select("id", "dist").mapInArrow(run, "data binary").toLocalIterator():
            f.write(bytes(row.data))


def write_range(results: DataFrame, path: str, queries: int) -> None:
    """(qid, id, dist) as a range file, ids of a query in ascending order."""
    ordered, total = results.orderBy("qid", "id"), results.count()
    every = results.sparkSession.range(queries).select(F.col("id").alias("qid")).join(results.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").fillna(0, ["n"]).orderBy("qid")
    with _create(path) as f:
        f.write(struct.pack("<ii", queries, total))
        for rows, column, element in ((every, "n", "<i4"), (ordered, "id", "<i4"), (ordered, "dist", "<f4")):
            for data in _pieces(rows, column, element):
                f.write(data)


def convert(spark: SparkSession, source: str, source_kind: str, target: str, target_kind: str, bound: int | None = None) -> None:
    """Rewrites a dense file in another layout, at most bound rows."""
    write_vectors(read(spark, source, source_kind, bound), target, target_kind)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """place, id from a file of an int32 count and that many int32 ids (entry points, list members)."""
    with _open(path) as f:
        n = int(_array(f, 0, 1, "<i4")[0])
        ids = _array(f, 4, n, "<i4").tolist()  # one number a big label
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "place long, id long")


def write_ids(ids: list[int], path: str) -> None:
    with _create(path) as f:
        f.write(np.array([len(ids), *ids], "<i4").tobytes())


def write_lists(members: DataFrame, centroids: DataFrame, path: str) -> None:
    """One label's lists: cluster numbers of its members by id in path-mem, centroids by cid in path-cen."""
    with _create(f"{path}-mem") as f:
        for data in _pieces(members.orderBy("id"), "cid", "<i4"):
            f.write(data)
    write_vectors(centroids.selectExpr("cid as id", "cv as v"), f"{path}-cen", "fbin")


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(place, cid) of the members in the order of their ids, and (cid, cv)."""
    return read(spark, f"{path}-mem", "int32").selectExpr("id as place", "x as cid"), read(spark, f"{path}-cen", "fbin").selectExpr("id as cid", "v as cv")


def read_list_file(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(place, cid) of the members, places being those in the label, and (cid, cv), from a file of the layout lists."""
    rows = read(spark, path, "lists", dim=dim)
    return rows.select(F.explode("ids").alias("place"), "cid"), rows.select("cid", "cv")
