import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, prep, sequence, sets
from lodestar.sources import native, text
from lodestar.sources.datasets import CATALOGUE


def seq(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i long, x long")


def test_scan_in_blocks(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    s = seq(spark, values)
    got = [r.scan for r in sequence.scan(s, block=3).orderBy("i").collect()]
    assert got == np.cumsum([0, *values[:-1]]).tolist()
    assert [r.scan for r in sequence.scan(s, "max", True, 3).orderBy("i").collect()] == np.maximum.accumulate(values).tolist()
    assert [r.scan for r in sequence.scan(s, "min", True, 3).orderBy("i").collect()] == np.minimum.accumulate(values).tolist()
    assert sequence.scan(s.limit(0)).count() == 0


def test_searches(spark):
    s = seq(spark, [5, 1, 2, 1, 2, 2])
    one = lambda d: d.first()[0]
    assert one(sequence.search(s, [1, 2])) == 1 and one(sequence.search(s, [1, 2], last=True)) == 3 and one(sequence.search(s, [9])) == 6
    assert one(sequence.adjacent_find(s)) == 4 and one(sequence.find_first(s, F.col("x") == 7)) == 6
    assert tuple(sequence.sorted_until(s).first()) == (False, 1)
    assert [tuple(r) for r in sequence.unique(seq(spark, [1, 1, 2, 1])).orderBy("i").collect()] == [(0, 1), (2, 2), (3, 1)]
    assert tuple(sequence.extremes(s).first()) == (1, 0)
    assert tuple(sequence.compare(s, s).first()) == (True, False)
    assert tuple(sequence.compare(seq(spark, [1]), seq(spark, [1, 0])).first()) == (False, True)
    assert one(sequence.kth_smallest(s, 2)) == 2


def test_order_index_is_dense_and_stable(spark):
    s = seq(spark, [(i * 37) % 11 for i in range(300)])
    got = sequence.order_index(s.withColumnRenamed("i", "was"), ["x", "was"]).orderBy("i").collect()
    assert [r.i for r in got] == list(range(300))
    assert [(r.x, r.was) for r in got] == sorted(((i * 37) % 11, i) for i in range(300))


def test_sets_and_intervals(spark):
    row = spark.createDataFrame([([1, 3, 5, 7], [3, 4, 5])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = row.select(sets.intersect(a, b), sets.difference(a, b), sets.difference(a, b, F.lit(7).cast("long")), sets.intersect_count(a, b, F.lit(5)), sets.is_subset(b, a), sets.union(a, b)).first()
    assert list(got) == [[3, 5], [1, 7], [1], 1, False, [1, 3, 4, 5, 7]]
    points = spark.createDataFrame([(10,), (19,), (20,), (20,)], "p long")
    spans = spark.createDataFrame([(10, 20), (20, 25)], "start long, stop long")
    assert sorted(map(tuple, sets.points_in_intervals(points, spans, 4).collect())) == [(10, 2), (20, 2)]
    assert sets.interval_overlap(spans, spans, 4).first()[0] == 15
    assert sets.interval_overlap(spans, spans, 4, upper=22).first()[0] == 12


def test_graph(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 0)], "src long, dst long")
    full = graph.symmetrize(edges)
    assert full.count() == 6 and graph.orient(full).count() == 3
    assert graph.max_degree(edges).first()[0] == 2
    tests = graph.edge_test(spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"), edges)
    assert sorted(map(tuple, tests.collect())) == [(0, 1, True), (0, 2, False)]


@pytest.mark.parametrize("kind", ["fbin", "u8bin", "i8bin", "ibin", "fvecs", "bvecs", "ivecs"])
def test_dense_round_trip(spark, tmp_path, kind):
    rows = [(i, [float((i * 7 + j) % 100) for j in range(3)]) for i in range(25)]
    path = str(tmp_path / f"x.{kind}")
    native.write_vectors(spark.createDataFrame(rows, "id long, v array<double>"), path, kind)
    got = native.read(spark, path, kind, rows=7)
    assert [(r.id, [float(x) for x in r.v]) for r in got.orderBy("id").collect()] == rows
    assert native.read(spark, path, kind, limit=4, rows=3).count() == 4
    native.convert(spark, path, kind, str(tmp_path / "y"), "fvecs", 5)
    assert native.read(spark, str(tmp_path / "y"), "fvecs").count() == 5


def test_sparse_graph_and_result_files(spark, tmp_path):
    entries = [(0, 4), (0, 1), (2, 3)]
    table = spark.createDataFrame(entries, "row long, col long")
    for kind in ("spmat", "spbit"):
        path = str(tmp_path / kind)
        native.write_matrix(table, path, 4, 5, kind == "spmat")
        assert [(r.row, r.col, r.val) for r in native.read(spark, path, kind, rows=2).orderBy("row", "col").collect()] == [(0, 1, 1.0), (0, 4, 1.0), (2, 3, 1.0)]
    native.write_graph(spark.createDataFrame([(0, 2), (0, 1), (2, 0)], "src long, dst long"), str(tmp_path / "g"), 3)
    assert sorted(map(tuple, native.read(spark, str(tmp_path / "g"), "graph", rows=1).collect())) == [(0, 1), (0, 2), (2, 0)]
    native.write_knn(spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 1.5), (1, 1, 7, 0.25)], "qid long, rank long, id long, dist double"), str(tmp_path / "k"), 2, 2)
    assert sorted(map(tuple, native.read(spark, str(tmp_path / "k"), "knn").collect())) == [(0, 1, 5, 0.5), (0, 2, 6, 1.5), (1, 1, 7, 0.25), (1, 2, -1, 0.0)]
    (tmp_path / "r").write_bytes(np.array([2, 3, 1, 2, 8, 9, 7], "<i4").tobytes() + np.array([1, 2, 3], "<f4").tobytes())
    assert sorted(map(tuple, native.read(spark, str(tmp_path / "r"), "range", rows=1).collect())) == [(0, 8, 1.0), (1, 7, 3.0), (1, 9, 2.0)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 2\nred big\nblue small\n")
    assert [tuple(r) for r in text.read_attributes(spark, str(tmp_path / "a.txt")).orderBy("id").collect()] == [(0, ["red", "big"]), (1, ["blue", "small"])]
    (tmp_path / "l.txt").write_text("3,7\n\n9\n")
    assert [tuple(r) for r in text.read_label_lines(spark, str(tmp_path / "l.txt")).orderBy("id", "label").collect()] == [(0, 3), (0, 7), (1, 9)]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(x) for x in ({"main_categories": ["b", "a"]}, {"label": "c"})))
    assert [tuple(r) for r in text.read_categories(spark, str(tmp_path / "c.json")).orderBy("id", "category").collect()] == [(0, "a"), (0, "b"), (1, "c")]


def test_labels_text_and_synthesis(spark):
    rows = spark.createDataFrame([(0, [3, 1]), (1, [])], "id long, labels array<long>")
    lines = rows.select("id", prep.label_text(F.col("labels"), 1, "25").alias("line"))
    assert [r.line for r in lines.orderBy("id").collect()] == ["2,4", "25"]
    ids = spark.range(50)
    picked = prep.distinct_labels(ids, 10, F.lit(4), 1)
    assert picked.count() == 200 and picked.distinct().count() == 200
    assert prep.random_vectors(spark, 10, 3, 2).count() == 10
    assert prep.random_queries(ids, 5).count() == 5


def test_catalogue_of_datasets():
    assert CATALOGUE["yfcc-10M"].search == "knn_filtered" and CATALOGUE["bigann-10M"].kind == "u8bin" and len(CATALOGUE) == 42


def test_ranges_of_files(spark, tmp_path):
    (tmp_path / "b").write_bytes(b"abcdef")
    assert native.read_bytes(str(tmp_path / "b"), 2, 4) == b"cd" and native.read_bytes(str(tmp_path / "b"), 4, 99, True) == b"ef\0" and native.read_bytes(str(tmp_path / "b"), 9) == b""
    (tmp_path / "f").write_bytes(np.array([3, 2, 2, 0, 1, 7, 8, 9], "<i4").tobytes())
    assert sorted(map(tuple, native.read(spark, str(tmp_path / "f"), "fixed", rows=1).collect())) == [(0, 7), (0, 8), (2, 9)]
    (tmp_path / "l").write_bytes(np.array([2], "<u8").tobytes() + np.array([1, 2, 3, 4], "<f4").tobytes() + np.array([0, 1, 3, 5, 6, 4], "<i4").tobytes())
    members, centroids = native.read_list_file(spark, str(tmp_path / "l"), 2)
    assert sorted(map(tuple, members.collect())) == [(4, 1), (5, 0), (6, 1)] and [r.cv for r in centroids.orderBy("cid").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    native.write_range(spark.createDataFrame([(0, 8, 1.0), (2, 3, 2.0), (2, 1, 4.0)], "qid long, id long, dist double"), str(tmp_path / "r"), 4)
    assert sorted(map(tuple, native.read(spark, str(tmp_path / "r"), "range", rows=1).collect())) == [(0, 8, 1.0), (2, 1, 4.0), (2, 3, 2.0)]
    spec = CATALOGUE["random-xs"]
    native.write_vectors(spark.range(20).selectExpr("id", "array(cast(id as double)) as v"), str(tmp_path / "random-xs_base.fbin"), "fbin")
    assert [r.id for r in spec.rows(spark, str(tmp_path), 5, 9).orderBy("id").collect()] == [5, 6, 7, 8]
    assert sum(1 for _ in spec.blocks(spark, str(tmp_path), 500, (4, 1))) == 5


def test_labelled_graph(spark, tmp_path):
    edges = spark.createDataFrame([(0, 2, 5), (0, 1, 4), (2, 0, 5)], "src long, dst long, label long")
    vertices = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "id long, label long")
    native.write_graph(edges, str(tmp_path / "g"), 3, vertices)
    meta = native.read_meta(str(tmp_path / "g"))
    assert (meta["vertices"], meta["edges"], meta["max_degree"], meta["vertex_classes"], meta["edge_classes"]) == (3, 3, 2, 2, 2)
    v, e = native.read_labelled_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, v.collect())) == [(0, 1), (1, 2), (2, 1)] and sorted(map(tuple, e.collect())) == [(0, 1, 4), (0, 2, 5), (2, 0, 5)]
    assert tuple(graph.label_classes(e).first()) == (2, 5) and [tuple(r) for r in graph.nth_edge_label(e, 1).collect()] == [(0, 5)]
    assert [tuple(r) for r in graph.vertex_label(spark.createDataFrame([(1,)], "id long"), v).collect()] == [(1, 2)]
    assert [tuple(r) for r in graph.frequent_labels(e, 1).collect()] == [(5, 2)]


def test_entry_without_llm(tmp_path):
    """The rest works when the corpus subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lodestar"), tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_list_and_id_files(spark, tmp_path):
    native.write_ids([4, 9], str(tmp_path / "e"))
    assert [tuple(r) for r in native.read_ids(spark, str(tmp_path / "e")).orderBy("place").collect()] == [(0, 4), (1, 9)]
    members = spark.createDataFrame([(7, 1), (3, 0)], "id long, cid long")
    centroids = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "cid long, cv array<double>")
    native.write_lists(members, centroids, str(tmp_path / "i"))
    got, cen = native.read_lists(spark, str(tmp_path / "i"))
    assert [r.cid for r in got.orderBy("place").collect()] == [0, 1] and [r.cv for r in cen.orderBy("cid").collect()] == [[1.0], [2.0]]


def test_summary_is_one_file_with_one_header(spark, tmp_path):
    from lodestar.operators import metrics

    row = [("i", 10, 5, 1.5, 0.9, 100.0, 20.0)]
    for _ in range(2):
        metrics.write_summary(spark.createDataFrame(row, list(metrics.SUMMARY)), str(tmp_path / "new" / "summary.csv"))
    assert (tmp_path / "new" / "summary.csv").read_text() == ",".join(metrics.SUMMARY) + "\n" + "i,10,5,1.5,0.9,100.0,20.0\n" * 2
    stats = spark.createDataFrame([("ivf", 2, 19, 0.95, 40)], "case_name string, n long, hits long, recall double, dist_comps long")
    assert metrics.case_lines(stats).first().line == "ivf 0.95 recall, 40 dist comps, 2 total"


def test_prepared_labels(spark, tmp_path):
    from lodestar.plans import prepare

    base = spark.createDataFrame([(0, ["x", "q"]), (1, ["y", "p"]), (2, ["x", None])], "id long, attributes array<string>")
    asked = spark.createDataFrame([(0, ["y", "q"]), (1, ["z", "q"])], "id long, attributes array<string>")
    rows, queries, classes = prepare.attribute_labels(base, asked, 2)
    assert classes.first().classes == 4 and sorted(map(tuple, rows.collect())) == [(0, 0), (1, 3)] and [tuple(r) for r in queries.collect()] == [(0, 2)]
    labels = spark.createDataFrame([(0, 3), (0, 1), (2, 0)], "id long, label long")
    prepare.write_labels(labels, str(tmp_path), 3, 4)
    lines = {name: [r.line for r in text.numbered_lines(spark, str(tmp_path / f"{name}.txt")).orderBy("id").collect()] for name in ("labels_comma", "labels_shifted")}
    assert lines == {"labels_comma": ["1,3", "-1", "0"], "labels_shifted": ["2,4", "5", "1"]}
    assert sorted((r.row, r.col) for r in native.read(spark, str(tmp_path / "base.metadata.spmat"), "spmat").collect()) == [(0, 1), (0, 3), (2, 0)]


def test_clear_deletes_what_was_cut(spark, tmp_path):
    from lodestar import storage

    before = len(storage._FOLDERS)
    storage.cut(spark.range(3))
    path = storage._FOLDERS[-1].removeprefix("file://")
    kept, storage._FOLDERS[:] = storage._FOLDERS[:before], storage._FOLDERS[before:]
    assert os.path.isdir(path) and storage.clear(spark) == 1 and not os.path.exists(path)
    storage._FOLDERS[:] = kept
