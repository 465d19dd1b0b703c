"""The queries of the library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.fixtures import DIM, edges, queries, table, vec_labels, vectors
from lodestar.functions import distance as dist
from lodestar.functions import scalar
from lodestar.operators import graph, knn, labels, metrics, prep, sequence, sets
from lodestar.plans import hybrid_graph, ivf, prepare, router
from lodestar.schema import SearchConfig
from lodestar.sources import native
from lodestar.storage import cut, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CFG = SearchConfig()

_V = """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
  list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS u FROM embeddings)"""
_L = """vl AS (
  SELECT vec_id AS id, j AS label FROM embeddings, range(20) t(j) WHERE ((vec_id + 1) * (j + 3) * 7919 + vec_id * vec_id * 31 + j * j * 17) % 1009 < 404
  UNION ALL SELECT vec_id, 20 FROM embeddings WHERE vec_id % 50 = 0
  UNION ALL SELECT vec_id, 21 FROM embeddings WHERE vec_id % 25 = 1
  UNION ALL SELECT vec_id, 22 FROM embeddings WHERE vec_id % 100 = 7)"""
_Q = """q0 AS (SELECT *, (id // 10 * 7 + 3) % 20 AS a, ((id // 10 * 7 + 3) % 20 + 1 + id // 10 % 19) % 20 AS b FROM vectors WHERE id % 10 = 3),
q AS (SELECT *, (b + 1 + id // 10 % 17) % 20 AS c FROM q0)"""
_S = "s AS (SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS i, (o_custkey * 7919 + o_orderkey * 31) % 1000 AS x FROM orders)"
_E = "e AS (SELECT c_custkey AS src, s_suppkey + 1000000 AS dst FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE (c_custkey + s_suppkey) % 7 = 0)"
_SZ = "sz AS (SELECT label, count(*) AS n FROM vl GROUP BY label)"
_L2 = "list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - w.v[i]) * (q.v[i] - w.v[i])))"
_L2U = "CAST(list_sum(list_transform(range(1, 65), lambda i: (q.u[i] - w.u[i]) * (q.u[i] - w.u[i]))) AS BIGINT)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _topk(dist_sql: str, source: str, k: int = 10, order: str = "ASC") -> str:
    return f"SELECT qid, rank, id, dist FROM (SELECT q.id AS qid, w.id AS id, {dist_sql} AS dist, row_number() OVER (PARTITION BY q.id ORDER BY {dist_sql} {order}, w.id) AS rank FROM {source}) WHERE rank <= {k}"


def _seq(spark, d):
    o = table(spark, d, "orders")
    low = o.agg(F.min("o_orderkey").alias("low"))
    return o.join(F.broadcast(low)).select((F.col("o_orderkey") - F.col("low")).alias("i"), F.expr("(o_custkey * 7919 + o_orderkey * 31) % 1000").alias("x"))


def _rows(spark, d):
    """id, own and next sorted label sets."""
    r = labels.label_rows(vec_labels(spark, d))
    n = r.select((F.col("id") - 1).alias("id"), F.col("labels").alias("b"))
    return r.withColumnRenamed("labels", "a").join(n, "id")


_R = f"WITH {_L}, r AS (SELECT id, list_sort(list(label)) AS a FROM vl GROUP BY id), p AS (SELECT r.id, r.a, n.a AS b FROM r JOIN r n ON n.id = r.id + 1)"
_BOTH = "list_sort(list_filter(a, lambda x: list_contains(b, x)))"
_EXCEPT = "list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))"


def _line(x):
    return F.array_join(F.transform(x, lambda y: y.cast("string")), ",")


# nearest neighbours


@query(f"WITH {_V}, {_L}, {_Q} " + _topk(_L2, "q JOIN vl ON vl.label = q.a JOIN vectors w ON w.id = vl.id"))
def knn_single_label(spark, d):
    return knn.filtered_knn(queries(spark, d, 1), vec_labels(spark, d), vectors(spark, d), 10, DIM)


@query(f"WITH {_V}, {_L}, {_Q} " + _topk(_L2, "q JOIN vl x ON x.label = q.a JOIN vl y ON y.label = q.b AND y.id = x.id JOIN vectors w ON w.id = x.id"))
def knn_double_label(spark, d):
    return knn.filtered_knn(queries(spark, d, 2), vec_labels(spark, d), vectors(spark, d), 10, DIM)


@query(f"WITH {_V}, {_L}, {_Q} " + _topk(_L2, "q JOIN vl x ON x.label = q.a JOIN vl y ON y.label = q.b AND y.id = x.id JOIN vl z ON z.label = q.c AND z.id = x.id JOIN vectors w ON w.id = x.id WHERE q.c <> q.a AND q.c <> q.b"))
def knn_multi_label(spark, d):
    return knn.filtered_knn(queries(spark, d, 3), vec_labels(spark, d), vectors(spark, d), 10, DIM)


@query(f"WITH {_V}, {_L} " + _topk(_L2U, "vectors q JOIN vl ON q.id % 10 = 3 AND vl.label = 22 JOIN vectors w ON w.id = vl.id"))
def knn_short_result(spark, d):
    q = queries(spark, d, 1, True).withColumn("qlabels", F.array(F.lit(22).cast("long")))
    return knn.filtered_knn(q, vec_labels(spark, d), vectors(spark, d, True), 10, DIM, "long")


@query(f"WITH {_V} " + _topk(_L2, "vectors q JOIN vectors w ON q.id % 10 = 3"))
def knn_unfiltered(spark, d):
    return knn.unfiltered_knn(queries(spark, d, 1), vectors(spark, d), 10, DIM)


@query(f"WITH {_V} " + _topk(_L2, "vectors q JOIN vectors w ON q.id % 10 = 3 AND w.id <> q.id"))
def knn_self_excluding(spark, d):
    return knn.unfiltered_knn(queries(spark, d, 1), vectors(spark, d), 10, DIM, exclude_self=True)


@query(f"WITH {_V} " + _topk(_L2, "vectors q JOIN vectors w ON q.id % 10 = 3 AND q.id % 2 <> w.id % 2"))
def knn_partitioned_population(spark, d):
    q = queries(spark, d, 1).withColumn("population", (F.col("qid") + 1) % 2)
    return knn.partitioned_knn(q, vectors(spark, d).withColumn("population", F.col("id") % 2), 10, DIM)


@query(f"WITH {_V}, c AS (SELECT id, list_transform(u, lambda x: x // 64) AS u FROM vectors) " + _topk(_L2U, "c q JOIN c w ON q.id % 10 = 3"))
def knn_tie_break(spark, d):
    coarse = lambda c: F.transform(c, lambda x: F.floor(x / 64).cast("long"))
    q = queries(spark, d, 1, True).withColumn("qv", coarse(F.col("qv")))
    return knn.unfiltered_knn(q, vectors(spark, d, True).withColumn("v", coarse(F.col("v"))), 10, DIM, "long")


@query(f"WITH {_V}, x AS (SELECT q.id AS qid, w.id AS id, {_L2U} AS dist FROM vectors q JOIN vectors w ON q.id % 10 = 3) SELECT * FROM x WHERE dist < 28000")
def range_search(spark, d):
    return knn.range_search(queries(spark, d, 1, True), vectors(spark, d, True), 28000, DIM, "long")


@query(f"WITH {_V}, x AS (SELECT q.id AS qid, {_L2U} AS dist FROM vectors q JOIN vectors w ON q.id % 10 = 3) SELECT qid, count(*) AS n FROM x WHERE dist < 28000 GROUP BY qid")
def range_count(spark, d):
    return range_search(spark, d).groupBy("qid").agg(F.count("*").alias("n"))


def _hundredth(spark, d, u8=False):
    """Rows with ids divisible by 100, as queries."""
    return vectors(spark, d, u8).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))


_DOTU = "CAST(list_sum(list_transform(range(1, 65), lambda i: q.u[i] * w.u[i])) AS BIGINT)"


@query(f"WITH {_V} " + _topk(_DOTU, "vectors q JOIN vectors w ON q.id % 10 = 3", order="DESC"))
def max_inner_product(spark, d):
    return knn.max_inner_product(queries(spark, d, 1, True), vectors(spark, d, True), 10, DIM, "long")


@query(f"WITH {_V} SELECT q.id AS qid, w.id AS id, -{_DOTU} AS dist FROM vectors q JOIN vectors w ON q.id % 100 = 0")
def neg_inner_product(spark, d):
    met = knn.all_pairs(_hundredth(spark, d, True), vectors(spark, d, True))
    return met.select("qid", "id", dist.negative_inner_product(F.col("qv"), F.col("v"), DIM, "long").alias("dist"))


def _tokens(spark, d, condition="true"):
    """doc_id, cols, vals: the distinct tokens of each row of documents and how often they occur; lower case by Spark."""
    return table(spark, d, "documents").where("text is not null").where(condition).select("doc_id", F.lower("text").alias("text")).mapInArrow(sequence.counted, "doc_id long, cols array<string>, vals array<long>")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r\\v]+')) AS col FROM documents), c AS (SELECT doc_id, col, count(*) AS val FROM t WHERE col <> '' GROUP BY ALL),
s AS (SELECT q.doc_id AS qid, c.doc_id AS id, CAST(sum(q.val * c.val) AS BIGINT) AS dist FROM c q JOIN c USING (col) WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist DESC, id) AS rank FROM s) WHERE rank <= 10""")
def sparse_mips(spark, d):
    chars = table(spark, d, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return knn.sparse_mips(_tokens(spark, d, "doc_id % 100 = 0").withColumnRenamed("doc_id", "qid"), _tokens(spark, d).withColumnRenamed("doc_id", "id"), 10, chars // 6)  # a token has about 5 characters and a space


@query(f"WITH {_V} SELECT q.id AS qid, w.id AS id, round(sqrt({_L2}), 6) AS dist FROM vectors q JOIN vectors w ON q.id % 100 = 0")
def l2_distance(spark, d):
    met = knn.all_pairs(_hundredth(spark, d), vectors(spark, d))
    return met.select("qid", "id", F.round(dist.l2(F.col("qv"), F.col("v"), DIM), 6).alias("dist"))


@query(f"WITH {_V} SELECT q.id AS qid, w.id AS id, {_L2U} AS dist FROM vectors q JOIN vectors w ON q.id % 100 = 0")
def l2_squared_u8(spark, d):
    met = knn.all_pairs(_hundredth(spark, d, True), vectors(spark, d, True))
    return met.select("qid", "id", dist.l2_squared(F.col("qv"), F.col("v"), None, "long").alias("dist"))


@query(f"""WITH {_V}, t AS (SELECT q.id AS qid, w.id AS id, i, (q.u[i] - w.u[i]) * (q.u[i] - w.u[i]) AS x FROM vectors q JOIN vectors w ON q.id % 100 = 0, range(1, 65) r(i)),
p AS (SELECT qid, id, i, CAST(sum(x) OVER (PARTITION BY qid, id ORDER BY i) AS BIGINT) AS s FROM t)
SELECT qid, id, coalesce(min(s) FILTER (WHERE s > 20000), max(s)) AS dist FROM p GROUP BY qid, id""")
def l2_early_stop(spark, d):
    met = knn.all_pairs(_hundredth(spark, d, True), vectors(spark, d, True))
    return met.select("qid", "id", dist.l2_early_stop(F.col("qv"), F.col("v"), F.lit(20000), "long").alias("dist"))


# labels


@query(f"WITH {_L} SELECT label, count(*) AS n FROM vl GROUP BY label")
def label_frequency(spark, d):
    return labels.label_sizes(vec_labels(spark, d))


@query(f"WITH {_L}, {_SZ} SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS ordinal FROM sz WHERE n > 50")
def big_labels(spark, d):
    return labels.big_labels(vec_labels(spark, d), CFG.big_cutoff)


@query(f"WITH {_L} SELECT label, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM vl GROUP BY label")
def posting_lists(spark, d):
    return labels.posting_lists(vec_labels(spark, d)).select("label", _line(F.col("ids")).alias("ids"))


@query(f"WITH {_L} SELECT vec_id AS id, EXISTS (SELECT 1 FROM vl WHERE vl.id = vec_id AND label = 5) AS member FROM embeddings")
def label_membership(spark, d):
    own = vec_labels(spark, d).where("label = 5").select("id", F.lit(True).alias("hit"))
    return vectors(spark, d).select("id").join(own, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("member"))


@query(f"WITH {_L} SELECT label, CAST(count(DISTINCT id) AS BIGINT) AS n FROM vl GROUP BY label")
def label_bitmap_count(spark, d):
    return labels.label_bitmaps(vec_labels(spark, d)).groupBy("label").agg(F.sum(F.bitmap_count("bits")).alias("n"))


_PAIRS = "pr AS (SELECT x.label AS a, y.label AS b, count(*) AS n FROM vl x JOIN vl y ON x.id = y.id AND x.label < y.label GROUP BY ALL)"


@query(f"WITH {_L}, {_PAIRS} SELECT a, b, n FROM pr")
def pair_intersections(spark, d):
    return labels.pair_sizes(vec_labels(spark, d))


@query(f"WITH {_L}, {_SZ}, {_PAIRS}, ok AS (SELECT a, b FROM pr JOIN sz s ON s.label = a AND s.n > 50 JOIN sz t ON t.label = b AND t.n > 50 WHERE pr.n <= 80) SELECT a, b, x.id FROM ok JOIN vl x ON x.label = a JOIN vl y ON y.label = b AND y.id = x.id")
def pair_cache(spark, d):
    return labels.pair_cache(vec_labels(spark, d), CFG.big_cutoff, CFG.precomp_cutoff)[1]


@query("SELECT i, j, i * 20 - i * (i + 1) // 2 + (j - i - 1) AS place FROM range(20) a(i), range(20) b(j) WHERE i < j")
def pair_triangular_index(spark, d):
    n = spark.range(20).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("j")).where("i < j")
    return n.select("i", "j", labels.triangular_index(F.col("i"), F.col("j"), F.lit(20)).alias("place"))


_SPEC = "sp AS (SELECT q.id AS qid, count(y.id) AS n FROM q LEFT JOIN vl x ON x.label = q.a LEFT JOIN vl y ON y.label = q.b AND y.id = x.id GROUP BY q.id)"


@query(f"WITH {_V}, {_L}, {_Q}, {_SPEC} SELECT qid, n FROM sp")
def query_specificity(spark, d):
    return labels.specificity(queries(spark, d, 2), vec_labels(spark, d))


@query(f"WITH {_V}, {_L}, {_Q}, {_SPEC}, r AS (SELECT qid, n, row_number() OVER (ORDER BY n, qid) - 1 AS place, count(*) OVER () AS total FROM sp) SELECT CAST(p AS BIGINT) AS percent, qid, n FROM r, (VALUES (1), (25), (50), (75)) t(p) WHERE abs(100 * place / total - p) <= 1")
def specificity_percentiles(spark, d):
    return labels.percentile_slices(query_specificity(spark, d), (1, 25, 50, 75))


@query(f"WITH {_V}, {_Q} SELECT id AS qid, CASE WHEN c <> a AND c <> b THEN 3 ELSE 2 END AS arity FROM q")
def split_queries_by_arity(spark, d):
    three = queries(spark, d, 3).select("qid", F.size("qlabels").alias("arity"))
    two = queries(spark, d, 2).select("qid", F.size("qlabels").alias("arity")).join(three.select("qid"), "qid", "left_anti")
    return three.unionByName(two)


@query(f"WITH {_L} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id AS old_id, label AS own FROM embeddings WHERE vec_id IN (SELECT id FROM vl WHERE vl.label = 7)")
def gather_subset(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    return prep.subset(rows, vec_labels(spark, d).where("label = 7")).select("id", "old_id", "own")


_ROUTE = f"""WITH {_V}, {_L}, {_Q}, {_SZ}, {_PAIRS},
two AS (SELECT q.id AS qid, q.a AS x, q.b AS y, s.n AS nx, t.n AS ny FROM q JOIN sz s ON s.label = q.a JOIN sz t ON t.label = q.b),
o AS (SELECT qid, CASE WHEN (nx, x) < (ny, y) THEN x ELSE y END AS a, least(nx, ny) AS size_a, CASE WHEN (nx, x) < (ny, y) THEN y ELSE x END AS b, greatest(nx, ny) AS size_b FROM two),
r AS (SELECT o.*, coalesce(pr.n, 0) AS pair_n FROM o LEFT JOIN pr ON pr.a = least(o.a, o.b) AND pr.b = greatest(o.a, o.b)),
f AS (SELECT qid, CAST(2 AS BIGINT) AS arity, a, size_a, b, size_b, pair_n, CASE WHEN size_a <= 50 THEN 'brute2' WHEN pair_n <= 80 THEN 'precomp' ELSE 'ivf' END AS strategy FROM r
  UNION ALL SELECT q.id + 1000000, 1, q.a, s.n, NULL, NULL, NULL, CASE WHEN s.n <= 50 THEN 'brute' ELSE 'hybridgraph' END FROM q JOIN sz s ON s.label = q.a
  UNION ALL SELECT q.id + 2000000, 1, 20 + q.id // 10 % 3, s.n, NULL, NULL, NULL, CASE WHEN s.n <= 50 THEN 'brute' ELSE 'hybridgraph' END FROM q JOIN sz s ON s.label = 20 + q.id // 10 % 3),
z AS (SELECT *, CASE WHEN arity = 1 THEN strategy ELSE strategy || '-smallxsmall' END AS case_name FROM f)"""


def _mixed(spark, d, u8=True):
    two, one = queries(spark, d, 2, u8), queries(spark, d, 1, u8)
    rare = one.withColumn("qlabels", F.array(F.expr("20 + qid div 10 % 3")))
    return two.unionByName(one.withColumn("qid", F.col("qid") + 1_000_000)).unionByName(rare.withColumn("qid", F.col("qid") + 2_000_000))


@query(_ROUTE + " SELECT qid, arity, a, size_a, b, size_b, pair_n, strategy, case_name FROM z")
def router_strategy(spark, d):
    return router.route(_mixed(spark, d), vec_labels(spark, d), CFG)


@query(_ROUTE + " SELECT case_name, count(*) AS n, CAST(sum(size_a) AS BIGINT) AS smaller FROM z GROUP BY case_name")
def router_case_counts(spark, d):
    return router_strategy(spark, d).groupBy("case_name").agg(F.count("*").alias("n"), F.sum("size_a").alias("smaller"))


@query(_ROUTE + f""", m AS (SELECT z.qid, z.qid % 1000000 AS src, x.id FROM z JOIN vl x ON x.label = z.a WHERE z.b IS NULL OR EXISTS (SELECT 1 FROM vl y WHERE y.label = z.b AND y.id = x.id)),
s AS (SELECT m.qid, m.id, {_L2U} AS dist FROM m JOIN vectors q ON q.id = m.src JOIN vectors w ON w.id = m.id)
SELECT t.qid, t.rank, t.id, t.dist, z.strategy FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s) t JOIN z ON z.qid = t.qid WHERE rank <= 10""")
def routed_search(spark, d):
    return router.routed_search(_mixed(spark, d), vec_labels(spark, d), vectors(spark, d, True), CFG, DIM, "long")


@query(_ROUTE + " SELECT qid, row_number() OVER (ORDER BY coalesce(size_b, size_a) DESC, arity DESC, size_a DESC, qid) AS place FROM z")
def query_schedule_order(spark, d):
    order = Window.orderBy(F.desc(F.coalesce("size_b", "size_a")), F.desc("arity"), F.desc("size_a"), "qid")
    return router.sized(_mixed(spark, d), vec_labels(spark, d)).select("qid", F.row_number().over(order).cast("long").alias("place"))


@query(_ROUTE + """, m AS (SELECT z.qid, z.case_name, x.id FROM z JOIN vl x ON x.label = z.a WHERE z.b IS NULL OR EXISTS (SELECT 1 FROM vl y WHERE y.label = z.b AND y.id = x.id)),
c AS (SELECT qid, case_name, count(*) AS n FROM m GROUP BY ALL)
SELECT case_name, count(*) AS n, CAST(sum(least(n, 10)) AS BIGINT) AS hits, CAST(1 AS DOUBLE) AS recall, CAST(sum(n) AS BIGINT) AS dist_comps FROM c GROUP BY case_name""")
def router_case_stats(spark, d):
    return metrics.case_stats(_log(spark, d))


def _log(spark, d):
    """The log of the routed search of all queries."""
    q, vl, v = _mixed(spark, d), vec_labels(spark, d), vectors(spark, d, True)
    found = router.routed_search(q, vl, v, CFG, DIM, "long")
    truth = knn.filtered_knn(q, vl, v, 10, DIM, "long")
    cost = labels.specificity(q, vl).select("qid", F.col("n").alias("dist_comps"))
    return metrics.query_log(router.route(q, vl, CFG), metrics.recall_per_query(found, truth, 10), cost)


@query(_ROUTE + """, m AS (SELECT z.qid, x.id FROM z JOIN vl x ON x.label = z.a WHERE z.b IS NULL OR EXISTS (SELECT 1 FROM vl y WHERE y.label = z.b AND y.id = x.id)),
c AS (SELECT z.qid, count(m.id) AS n FROM z LEFT JOIN m ON m.qid = z.qid GROUP BY z.qid)
SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total_dist_comps, avg(n) AS avg_dist_comps, sum(least(n, 10)) / (10 * count(*)) AS recall FROM c""")
def search_totals(spark, d):
    return metrics.totals(_log(spark, d), 10)


@query(_ROUTE + """, m AS (SELECT z.qid, x.id FROM z JOIN vl x ON x.label = z.a WHERE z.b IS NULL OR EXISTS (SELECT 1 FROM vl y WHERE y.label = z.b AND y.id = x.id)),
c AS (SELECT z.qid, count(m.id) AS n FROM z LEFT JOIN m ON m.qid = z.qid GROUP BY z.qid)
SELECT z.qid AS id, n AS comparisons, CAST(NULL AS DOUBLE) AS time, CAST(NULL AS DOUBLE) AS distance_time, size_a AS filter_count_a, coalesce(size_b, 0) AS filter_count_b, least(n, 10) AS recall, case_name AS "case",
  CAST(NULL AS BIGINT) AS iter, CAST(NULL AS BIGINT) AS hops, CAST(NULL AS BIGINT) AS push, CAST(NULL AS BIGINT) AS checks, CAST(NULL AS BIGINT) AS pass_filter, CAST(NULL AS BIGINT) AS clusters, CAST(NULL AS DOUBLE) AS filter_time
FROM z JOIN c ON c.qid = z.qid""")
def search_log(spark, d):
    """The log of queries of the exact search, which has no counters of graphs and clusters."""
    return metrics.log_table(_log(spark, d))


# clustered search

_KM = f"""WITH {_V}, {_L}, {_SZ}, pt AS (SELECT vl.label, w.id, w.u, row_number() OVER (PARTITION BY vl.label ORDER BY w.id) - 1 AS cid, sz.n FROM vl JOIN sz ON sz.label = vl.label AND sz.n > 50 JOIN vectors w ON w.id = vl.id),
c0 AS (SELECT label, cid, u FROM pt WHERE cid < (n + 99) // 100)"""


def _step(k: int) -> str:
    return f""",
m{k} AS (SELECT label, id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT q.label, q.id, w.cid, {_L2U} AS d FROM pt q JOIN c{k - 1} w ON w.label = q.label) GROUP BY label, id),
a{k} AS (SELECT m.label, m.cid, i, CAST(sum(pt.u[i]) AS BIGINT) // count(*) AS x FROM m{k} m JOIN pt ON pt.label = m.label AND pt.id = m.id, range(1, 65) r(i) GROUP BY ALL),
n{k} AS (SELECT label, cid, list(x ORDER BY i) AS u FROM a{k} GROUP BY label, cid),
c{k} AS (SELECT c.label, c.cid, coalesce(n.u, c.u) AS u FROM c{k - 1} c LEFT JOIN n{k} n ON n.label = c.label AND n.cid = c.cid)"""


def _points(spark, d):
    vl = vec_labels(spark, d)
    return ivf.points_of(vl, vectors(spark, d, True), labels.big_labels(vl, CFG.big_cutoff))


def _index(spark, d):
    return ivf.kmeans(_points(spark, d), CFG.cluster_size, DIM, "int", 3)


@query(_KM + _step(1) + " SELECT label, id, cid, d AS dist FROM m1")
def kmeans_assign_step(spark, d):
    p = _points(spark, d)
    return ivf.assign(p, ivf.first_centroids(p, CFG.cluster_size), DIM, "long")


@query(_KM + _step(1) + _step(2) + _step(3) + " SELECT label, id, cid FROM m3")
def kmeans_three_iterations(spark, d):
    return _index(spark, d)[1]


@query(_KM + _step(1) + _step(2) + _step(3) + _step(4) + " SELECT label, CAST(sum(d) AS BIGINT) AS inertia FROM m4 GROUP BY label")
def kmeans_inertia(spark, d):
    return ivf.inertia(_points(spark, d), _index(spark, d)[0], DIM, "long")


@query(_KM + _step(1) + _step(2) + _step(3) + " SELECT label, cid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM m3 GROUP BY label, cid")
def ivf_lists(spark, d):
    return ivf.lists(_index(spark, d)[1]).select("label", "cid", _line(F.col("ids")).alias("ids"))


_PROBE = _KM + _step(1) + _step(2) + _step(3) + f""", {_Q},
qa AS (SELECT q.id AS qid, q.u, s.label AS label, CASE WHEN s.label = q.a THEN q.b ELSE q.a END AS other FROM q JOIN sz s ON s.label IN (q.a, q.b) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY s.n, s.label) = 1),
rk AS (SELECT qid, label, cid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS place FROM (SELECT q.qid, q.label, w.cid, {_L2U} AS dist FROM qa q JOIN c3 w ON w.label = q.label)),
ps AS (SELECT rk.qid, m3.cid, rk.place, m3.id FROM rk JOIN m3 ON m3.label = rk.label AND m3.cid = rk.cid JOIN qa ON qa.qid = rk.qid JOIN vl ON vl.id = m3.id AND vl.label = qa.other)"""


def _asked(spark, d):
    q = queries(spark, d, 2, True)
    s = router.sized(q, vec_labels(spark, d)).select("qid", F.col("a").alias("label"), F.col("b").alias("other"))
    return q.select("qid", "qv").join(s, "qid")


def _passes(spark, d):
    return _asked(spark, d).select("qid", "other").join(vec_labels(spark, d).withColumnRenamed("label", "other"), "other").select("qid", "id")


@query(_PROBE + " SELECT qid, label, cid, dist, place FROM rk")
def ivf_centroid_rank(spark, d):
    return ivf.rank_centroids(_asked(spark, d), _index(spark, d)[0], DIM, "long")


def _both(spark, d):
    """_asked() with the other label as one that rows must carry."""
    return _asked(spark, d).select("qid", "qv", "label", F.array("other").alias("qlabels"))


def _tagged(spark, d):
    """Vectors with their labels."""
    return vectors(spark, d, True).join(labels.label_rows(vec_labels(spark, d)), "id")


def _probe(spark, d, n):
    c, m = _index(spark, d)
    return ivf.probe(_both(spark, d), c, m, _tagged(spark, d), 10, n, DIM, "long")


_PTOP = " SELECT qid, rank, id, dist FROM (SELECT ps.qid, w.id, {l2} AS dist, row_number() OVER (PARTITION BY ps.qid ORDER BY {l2}, w.id) AS rank FROM ps JOIN q ON q.id = ps.qid JOIN vectors w ON w.id = ps.id WHERE {where}) WHERE rank <= 10"


@query(_PROBE + _PTOP.format(l2=_L2U, where="ps.place <= 2"))
def ivf_probe_knn(spark, d):
    return _probe(spark, d, 2)[0]


@query(_PROBE + " SELECT rk.qid, count(DISTINCT rk.cid) AS n_centroids, count(DISTINCT ps.id) AS n_passing, count(DISTINCT rk.cid) FILTER (WHERE rk.place <= 2) AS n_clusters, count(DISTINCT rk.cid) + count(DISTINCT ps.id) AS dist_comps FROM rk LEFT JOIN ps ON ps.qid = rk.qid AND ps.cid = rk.cid AND rk.place <= 2 GROUP BY rk.qid")
def ivf_probe_cost(spark, d):
    return _probe(spark, d, 2)[1]


@query(f"WITH {_V}, {_L}, {_Q} " + _topk(_L2U, "q JOIN vl x ON x.label = q.a JOIN vl y ON y.label = q.b AND y.id = x.id JOIN vectors w ON w.id = x.id"))
def ivf_full_probe_equals_exact(spark, d):
    return _probe(spark, d, 1 << 20)[0]


@query(_PROBE + ", t AS (SELECT rk.qid, rk.label, rk.cid, rk.place, (SELECT count(*) FROM m3 WHERE m3.label = rk.label AND m3.cid = rk.cid) AS n FROM rk), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT b.qid, m3.id FROM b JOIN m3 ON m3.label = b.label AND m3.cid = b.cid WHERE before <= 60")
def ivf_near_target(spark, d):
    c, m = _index(spark, d)
    return ivf.near_target(_asked(spark, d), c, m, 60, DIM, "long")


@query(_PROBE + ", t AS (SELECT rk.qid, rk.cid, rk.place, (SELECT count(*) FROM ps WHERE ps.qid = rk.qid AND ps.cid = rk.cid) AS n FROM rk), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT b.qid, ps.id FROM b JOIN ps ON ps.qid = b.qid AND ps.cid = b.cid WHERE before <= 20 AND b.place <= 2")
def ivf_near_filter(spark, d):
    c, m = _index(spark, d)
    return ivf.near_target(_asked(spark, d), c, m, 20, DIM, "long", _passes(spark, d), 2)


@query(f"WITH {_V}, {_L}, {_Q} " + _topk(_L2U, "q JOIN vl x ON x.label = q.a JOIN vl y ON y.label = q.b AND y.id = x.id JOIN vectors w ON w.id = x.id AND w.id % 2 = 0"))
def ivf_predicate_search(spark, d):
    """Any condition on the rows besides the labels."""
    c, m = _index(spark, d)
    return ivf.probe(_both(spark, d), c, m, ivf.predicate(_tagged(spark, d), F.col("id") % 2 == 0), 10, 1 << 20, DIM, "long")[0]


# native files


def _file(spark, name):
    return f"{shared_dir(spark)}-{name}"


@query(f"WITH {_V} SELECT id, CAST(list_sum(u) AS BIGINT) AS total, u[1] AS first FROM vectors")
def native_dense_round_trip(spark, d):
    path = _file(spark, "base.u8bin")
    native.write_vectors(vectors(spark, d, True), path, "u8bin")
    return native.read(spark, path, "u8bin", rows=100).select("id", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("v")[0].cast("long").alias("first"))


@query(f"WITH {_V} SELECT id, u[64] AS last FROM vectors WHERE id >= 100 AND id < 350")
def native_range_read(spark, d):
    path = _file(spark, "base.bvecs")
    native.write_vectors(vectors(spark, d, True), path, "bvecs")
    return native.read(spark, path, "bvecs", 250, 100, rows=100).select("id", F.col("v")[63].cast("long").alias("last"))


@query(f"WITH {_L} SELECT id, label FROM vl")
def native_sparse_round_trip(spark, d):
    path = _file(spark, "labels.spmat")
    native.write_matrix(vec_labels(spark, d).selectExpr("id as row", "label as col"), path, table(spark, d, "embeddings").count(), 24)
    return native.read(spark, path, "spmat", rows=100).select(F.col("row").alias("id"), F.col("col").alias("label"))


@query(f"WITH {_L} SELECT vl.id AS src, vl.label AS dst, vl.id % 3 AS edge_label, vl.id % 7 AS vertex_label FROM vl")
def native_labelled_graph(spark, d):
    path, n = _file(spark, "graph"), table(spark, d, "embeddings").count()
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("label"))
    native.write_graph(vec_labels(spark, d).select(F.col("id").alias("src"), F.col("label").alias("dst"), (F.col("id") % 3).alias("label")), path, n, ids)
    vertices, found = native.read_labelled_graph(spark, path)
    return found.select("src", "dst", F.col("label").alias("edge_label")).join(vertices.select(F.col("id").alias("src"), F.col("label").alias("vertex_label")), "src")


@query(f"WITH {_V} " + _topk(_L2U, "vectors q JOIN vectors w ON q.id % 10 = 3"))
def native_results_round_trip(spark, d):
    path, n = _file(spark, "found.knn"), table(spark, d, "embeddings").count()
    found = knn.unfiltered_knn(queries(spark, d, 1, True), vectors(spark, d, True), 10, DIM, "long")
    native.write_knn(found, path, n, 10)
    return native.read(spark, path, "knn", rows=100).where("id >= 0").select("qid", "rank", "id", F.col("dist").cast("long").alias("dist"))


@query(f"WITH {_V} " + _topk(_L2U, "vectors q JOIN vectors w ON q.id % 10 = 3", 5).replace("SELECT qid, rank, id, dist", "SELECT qid // 10 AS qid, rank, id, CAST(0 AS BIGINT) AS dist", 1))
def native_pairs_round_trip(spark, d):
    """Ground truth cut to 5 places, as pairs of an id and a distance of 0, read again."""
    path, q = _file(spark, "found.pairs"), queries(spark, d, 1, True)
    found = knn.unfiltered_knn(q, vectors(spark, d, True), 10, DIM, "long").where("rank <= 5")
    native.write_pairs(found.select(F.expr("qid div 10").alias("qid"), "rank", "id", F.lit(0.0).alias("dist")), path, q.count(), 5)
    return native.read(spark, path, "pairs", rows=7, dim=5).select("qid", "rank", "id", F.col("dist").cast("long").alias("dist"))


@query(f"WITH {_V} " + _topk(_L2U, "vectors q JOIN vectors w ON q.id % 10 = 3", 5))
def truth_truncated(spark, d):
    """The first 5 of the 10 true neighbours."""
    return knn.unfiltered_knn(queries(spark, d, 1, True), vectors(spark, d, True), 10, DIM, "long").where("rank <= 5")


# evaluation


@query("SELECT CAST(1 AS DOUBLE) AS recall")
def padded_recall_of_truth(spark, d):
    """Places that both sides leave empty count as found."""
    q = queries(spark, d, 1, True).withColumn("qlabels", F.array(F.lit(22).cast("long")))
    found = knn.filtered_knn(q, vec_labels(spark, d), vectors(spark, d, True), 10, DIM, "long")
    return metrics.padded_recall(found, found, q, 10)


_EVAL = _PROBE + f""", g AS (SELECT * FROM ({_topk(_L2U, "q JOIN vl x ON x.label = q.a JOIN vl y ON y.label = q.b AND y.id = x.id JOIN vectors w ON w.id = x.id")})),
p AS ({_PTOP.format(l2=_L2U, where="ps.place <= 1")}),
h AS (SELECT g.qid, count(p.id) AS hits, count(*) AS wanted FROM g LEFT JOIN p ON p.qid = g.qid AND p.id = g.id GROUP BY g.qid)"""


def _truth(spark, d):
    return knn.filtered_knn(queries(spark, d, 2, True), vec_labels(spark, d), vectors(spark, d, True), 10, DIM, "long")


@query(_EVAL + " SELECT qid, hits, wanted, hits / wanted AS recall FROM h")
def recall_per_query(spark, d):
    return metrics.recall_per_query(_probe(spark, d, 1)[0], _truth(spark, d), 10)


@query(_EVAL + " SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(wanted) AS BIGINT) AS wanted, sum(hits) / sum(wanted) AS recall FROM h")
def recall_at_k(spark, d):
    return metrics.recall(_probe(spark, d, 1)[0], _truth(spark, d), 10)


_SWEPT = ", ".join(f"({n})" for n in (1, 2, 4))


@query(_PROBE + f""", g AS (SELECT * FROM ({_topk(_L2U, "q JOIN vl x ON x.label = q.a JOIN vl y ON y.label = q.b AND y.id = x.id JOIN vectors w ON w.id = x.id")})),
p AS (SELECT setting, ps.qid, w.id, row_number() OVER (PARTITION BY setting, ps.qid ORDER BY {_L2U}, w.id) AS rank FROM ps JOIN q ON q.id = ps.qid JOIN vectors w ON w.id = ps.id JOIN (VALUES {_SWEPT}) t(setting) ON ps.place <= setting)
SELECT CAST(t.setting AS BIGINT) AS setting, count(p.id) / count(*) AS recall FROM g CROSS JOIN (VALUES {_SWEPT}) t(setting) LEFT JOIN p ON p.setting = t.setting AND p.qid = g.qid AND p.id = g.id AND p.rank <= 10 GROUP BY t.setting""")
def probe_sweep(spark, d):
    """Recall by clusters probed; the index is built once."""
    c, m = _index(spark, d)
    run = lambda n: ivf.probe(_both(spark, d), c, m, _tagged(spark, d), 10, n, DIM, "long")[0]
    rows = metrics.sweep(run, _truth(spark, d), [1, 2, 4], 10)
    return spark.createDataFrame([(r["setting"], r["recall"]) for r in rows], "setting long, recall double")


@query("SELECT CAST(0 AS BIGINT) AS violations")
def filter_violation_check(spark, d):
    found = _probe(spark, d, 2)[0]
    return metrics.violations(found, queries(spark, d, 2), vec_labels(spark, d)).agg(F.count("*").alias("violations"))


@query(f"WITH {_L} SELECT x.id AS src, x.id + 1 AS dst, least(count(*) FILTER (WHERE y.id IS NOT NULL), 255) AS overlap FROM vl x LEFT JOIN vl y ON y.id = x.id + 1 AND y.label = x.label WHERE x.id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY x.id")
def label_overlap_matrix(spark, d):
    ids = vec_labels(spark, d).select(F.col("id").alias("src")).distinct().withColumn("dst", F.col("src") + 1)
    return labels.overlap(vec_labels(spark, d), ids.join(vectors(spark, d).select(F.col("id").alias("dst")), "dst", "left_semi"))


def _neighbours(spark, d):
    """Directed edges to the 8 nearest other rows."""
    v = vectors(spark, d, True)
    found = knn.unfiltered_knn(v.select(F.col("id").alias("qid"), F.col("v").alias("qv")), v, 8, DIM, "long", exclude_self=True)
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")


@query(f"WITH {_V}, {_L}, g AS ({_topk(_L2U, 'vectors q JOIN vectors w ON w.id <> q.id', 8)}), o AS (SELECT g.qid AS src, g.id AS dst, g.dist, count(*) AS overlap FROM g JOIN vl x ON x.id = g.qid JOIN vl y ON y.id = g.id AND y.label = x.label GROUP BY ALL) SELECT src, dst, dist, overlap FROM o WHERE overlap >= 2")
def shared_edge_candidates(spark, d):
    return hybrid_graph.shared_candidates(_neighbours(spark, d), vec_labels(spark, d), CFG.min_shared)


@query(f"WITH {_L}, {_SZ} SELECT max(label) AS max_label, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS nnz FROM sz")
def label_extent(spark, d):
    return labels.label_sizes(vec_labels(spark, d)).agg(F.max("label").alias("max_label"), F.count("*").alias("n_labels"), F.sum("n").alias("nnz"))


@query(f"WITH {_L}, {_SZ} SELECT label, n, CASE WHEN n <= 100 THEN 8 WHEN n <= 400 THEN 10 ELSE 12 END AS degree FROM sz WHERE n > 50")
def graph_degree_by_group(spark, d):
    return hybrid_graph.degrees(vec_labels(spark, d), CFG)


def _hybrid(spark, d, vl=None, v=None):
    vl, v = vl or vec_labels(spark, d), v or vectors(spark, d)
    p = ivf.points_of(vl, v, labels.big_labels(vl, CFG.big_cutoff))
    c, m = ivf.kmeans(p, CFG.cluster_size, DIM, "double", CFG.kmeans_iterations)
    return c, m, hybrid_graph.build(p, c, m, vl, v, CFG, DIM)


@query()
def hybrid_graph_degrees(spark, d):
    single, shared, _ = _hybrid(spark, d)[2]
    return single.groupBy("label", "src").count().groupBy("label").agg(F.max("count").alias("max_degree")).unionByName(shared.groupBy("src").count().agg(F.lit(-1).cast("long").alias("label"), F.max("count").alias("max_degree")))


@query()
def hybrid_graph_search(spark, d):
    single, shared, entries = _hybrid(spark, d)[2]
    q = queries(spark, d, 1).select("qid", "qv", F.col("qlabels")[0].alias("label"))
    return hybrid_graph.search(q, single, shared, entries, vec_labels(spark, d), vectors(spark, d), CFG)


@query(f"WITH {_L}, {_SZ} SELECT label, CAST(0 AS BIGINT) AS self_edges, CAST(0 AS BIGINT) AS outside, true AS within_degree FROM sz WHERE n > 50 UNION ALL SELECT -1, 0, 0, true")
def hybrid_graph_structure(spark, d):
    """Of each label's graph, and of the shared one (-1): edges to itself, edges that leave the label (or share too few labels), and whether no list exceeds its degree."""
    single, shared, _ = _hybrid(spark, d)[2]
    vl = vec_labels(spark, d)
    member = vl.select(F.col("id").alias("dst"), "label", F.lit(1).alias("hit"))
    counts = single.join(member, ["label", "dst"], "left").groupBy("label", "src").agg(F.count("*").alias("n_out"), F.count_if(F.col("src") == F.col("dst")).alias("self"), F.count_if(F.col("hit").isNull()).alias("out"))
    own = counts.join(hybrid_graph.degrees(vl, CFG).select("label", "degree"), "label").groupBy("label").agg(F.sum("self").alias("self_edges"), F.sum("out").alias("outside"), (F.max(F.col("n_out") - F.col("degree")) <= 0).alias("within_degree"))
    common = shared.groupBy("src").agg(F.count("*").alias("n_out"), F.count_if(F.col("src") == F.col("dst")).alias("self"), F.count_if(F.col("overlap") < CFG.min_shared).alias("out"))
    return own.unionByName(common.agg(F.lit(-1).cast("long").alias("label"), F.sum("self").alias("self_edges"), F.sum("out").alias("outside"), (F.max("n_out") <= CFG.shared_degree).alias("within_degree")))


@query(f"WITH {_V} SELECT id AS qid, true AS counted FROM vectors WHERE id % 10 = 3")
def hybrid_graph_counters(spark, d):
    """Whether a query's counters agree: rows found, put into the queue, measured; rows expanded were put in before."""
    found = hybrid_graph_search(spark, d).groupBy("qid").agg(F.count("*").alias("n"), F.max("dist_comps").alias("dist_comps"), F.max("hops").alias("hops"), F.max("pushed").alias("pushed"))
    return found.select("qid", ((F.col("n") <= F.col("pushed")) & (F.col("hops") <= F.col("pushed")) & (F.col("pushed") <= F.col("dist_comps")) & (F.col("hops") > 0)).alias("counted"))


@query(_ROUTE + " SELECT case_name, count(*) AS n, true AS recall_reached FROM z GROUP BY case_name")
def routed_index_recall(spark, d):
    """Queries routed to cached pairs, clusters and graphs, the last two completed by bounds: whether each case's recall at 10 reaches 0.9, or 0.5 where few clusters are probed."""
    q, vl, v = cut(_mixed(spark, d, False), "queries"), cut(vec_labels(spark, d), "labels"), cut(vectors(spark, d), "vectors")
    centroids, members, graph = _hybrid(spark, d, vl, v)
    found = router.routed_search(q, vl, v, CFG, DIM, "double", router.indexed(vl, v, (centroids, members), graph, CFG, DIM, "double"))
    per_query = metrics.recall_per_query(found, knn.filtered_knn(q, vl, v, 10, DIM), 10)
    joined = router.route(q, vl, CFG).select("qid", "case_name").join(per_query, "qid").groupBy("case_name").agg(F.count("*").alias("n"), (F.sum("hits") / F.sum("wanted")).alias("recall"))
    return joined.select("case_name", "n", (F.col("recall") >= F.when(F.col("case_name").startswith("ivf"), 0.5).otherwise(0.9)).alias("recall_reached"))


# sets


@query(_R + f" SELECT id, array_to_string({_BOTH}, ',') AS x FROM p")
def set_intersect(spark, d):
    return _rows(spark, d).select("id", _line(sets.intersect(F.col("a"), F.col("b"))).alias("x"))


@query(_R + f" SELECT id, array_to_string(list_filter({_BOTH}, lambda y: y < 10), ',') AS x FROM p")
def set_intersect_bounded(spark, d):
    return _rows(spark, d).select("id", _line(sets.intersect(F.col("a"), F.col("b"), F.lit(10))).alias("x"))


@query(_R + f" SELECT id, CAST(len({_BOTH}) AS BIGINT) AS n, CAST(len(list_filter({_BOTH}, lambda y: y < 10)) AS BIGINT) AS n_bounded, CAST(len(list_filter({_BOTH}, lambda y: y <> 3)) AS BIGINT) AS n_one, CAST(len(list_filter({_BOTH}, lambda y: y < 10 AND y <> 3 AND y <> 4)) AS BIGINT) AS n_two FROM p")
def set_intersect_counts(spark, d):
    a, b = F.col("a"), F.col("b")
    return _rows(spark, d).select("id", sets.intersect_count(a, b).alias("n"), sets.intersect_count(a, b, F.lit(10)).alias("n_bounded"), sets.intersect_count(a, b, None, (F.lit(3).cast("long"),)).alias("n_one"), sets.intersect_count(a, b, F.lit(10), (F.lit(3).cast("long"), F.lit(4).cast("long"))).alias("n_two"))


@query(_R + f" SELECT id, array_to_string({_EXCEPT}, ',') AS x, array_to_string(list_filter({_EXCEPT}, lambda y: y <> id % 20), ',') AS x_own FROM p")
def set_except(spark, d):
    return _rows(spark, d).select("id", _line(sets.difference(F.col("a"), F.col("b"))).alias("x"), _line(sets.difference(F.col("a"), F.col("b"), F.col("id") % 20)).alias("x_own"))


@query(_R + f" SELECT id, array_to_string(list_filter({_EXCEPT}, lambda y: y < 10), ',') AS x, CAST(len(list_filter({_EXCEPT}, lambda y: y < 10)) AS BIGINT) AS n FROM p")
def set_except_bounded(spark, d):
    x = sets.difference(F.col("a"), F.col("b"), None, F.lit(10))
    return _rows(spark, d).select("id", _line(x).alias("x"), F.size(x).cast("long").alias("n"))


@query(_R + f" SELECT id, len({_EXCEPT}) = 0 AS subset, array_to_string(list_filter(a, lambda y: y < 7), ',') AS below, CAST(len(list_filter(a, lambda y: y < 7)) AS BIGINT) AS place FROM p")
def set_subset_bounded(spark, d):
    below = sets.bounded(F.col("a"), F.lit(7))
    return _rows(spark, d).select("id", sets.is_subset(F.col("a"), F.col("b")).alias("subset"), _line(below).alias("below"), F.size(below).cast("long").alias("place"))


@query(_R + " SELECT id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS x FROM p")
def set_union(spark, d):
    return _rows(spark, d).select("id", _line(sets.union(F.col("a"), F.col("b"))).alias("x"))


def _intervals(spark, shift=0, width=37):
    return spark.range(40).select((F.col("id") * 100 + shift).alias("start"), (F.col("id") * 100 + shift + width).alias("stop"))


@query("SELECT k * 100 AS start, count(*) AS n FROM range(40) t(k) JOIN lineitem ON l_partkey >= k * 100 AND l_partkey < k * 100 + 37 GROUP BY k")
def points_in_intervals(spark, d):
    return sets.points_in_intervals(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p")), _intervals(spark), 100)


@query("SELECT CAST(sum(greatest(0, least(a.k * 100 + 37, b.k * 100 + 95) - greatest(a.k * 100, b.k * 100 + 20))) AS BIGINT) AS total FROM range(40) a(k), range(40) b(k)")
def interval_overlap_length(spark, d):
    return sets.interval_overlap(_intervals(spark), _intervals(spark, 20, 75), 50)


@query("SELECT k * 100 AS start, count(*) AS n FROM range(40) t(k) JOIN lineitem ON l_partkey >= k * 100 AND l_partkey < k * 100 + 37 AND l_partkey < 150 GROUP BY k")
def points_in_intervals_bounded(spark, d):
    return sets.points_in_intervals(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p")), _intervals(spark), 100, 150)


@query("SELECT CAST(sum(greatest(0, least(a.k * 100 + 37, b.k * 100 + 95, 1930) - greatest(a.k * 100, b.k * 100 + 20))) AS BIGINT) AS total FROM range(40) a(k), range(40) b(k)")
def interval_overlap_bounded(spark, d):
    return sets.interval_overlap(_intervals(spark), _intervals(spark, 20, 75), 50, 1930)


# graphs


@query(f"WITH {_E} SELECT src, count(*) AS degree FROM e GROUP BY src")
def graph_out_degree(spark, d):
    return graph.out_degrees(edges(spark, d))


@query(f"WITH {_E} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS out FROM e GROUP BY src")
def graph_neighbors(spark, d):
    return graph.neighbours(edges(spark, d)).select("src", _line(F.col("out")).alias("out"))


@query(f"WITH {_E} SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM e) WHERE r = 2")
def graph_nth_neighbor(spark, d):
    return graph.nth_neighbour(edges(spark, d), 1)


@query(f"WITH {_E} SELECT dst AS src, src AS dst FROM e")
def graph_reverse(spark, d):
    return graph.reverse(edges(spark, d))


_SYM = f"WITH {_E}, y AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(_SYM + " SELECT src, dst FROM y")
def graph_symmetrize(spark, d):
    return graph.symmetrize(edges(spark, d))


@query(_SYM + ", g AS (SELECT src, count(*) AS n FROM y GROUP BY src) SELECT y.src, y.dst FROM y JOIN g a ON a.src = y.src JOIN g b ON b.src = y.dst WHERE (a.n, y.src) < (b.n, y.dst)")
def graph_orientation(spark, d):
    return graph.orient(graph.symmetrize(edges(spark, d)))


@query(f"WITH {_E} SELECT c_custkey AS src, 1000001 AS dst, EXISTS (SELECT 1 FROM e WHERE src = c_custkey AND dst = 1000001) AS connected FROM customer")
def graph_edge_test(spark, d):
    pairs = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("src"), F.lit(1000001).cast("int").alias("dst"))
    return graph.edge_test(pairs, edges(spark, d)).withColumn("dst", F.col("dst").cast("int"))


@query(f"WITH {_E} SELECT max(n) AS max_degree FROM (SELECT count(*) AS n FROM e GROUP BY src)")
def graph_max_degree(spark, d):
    return graph.max_degree(edges(spark, d))


@query(f"WITH {_E} SELECT n // 2 * 2 AS low, count(*) AS n FROM (SELECT count(*) AS n FROM e GROUP BY src) GROUP BY 1")
def graph_degree_histogram(spark, d):
    return graph.degree_histogram(edges(spark, d), 2)


@query(f"WITH {_E} SELECT c_custkey % 5 AS qid, dst FROM customer JOIN e ON src = c_custkey GROUP BY ALL")
def graph_expand(spark, d):
    f = table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("qid"), F.col("c_custkey").alias("id"))
    return graph.expand(f, edges(spark, d))


# scalars


@query(f"WITH {_S} SELECT i, CAST(CASE WHEN x <= 1 THEN 0 ELSE length(bin(x - 1)) END AS BIGINT) AS log2_up FROM s")
def fn_log2_up(spark, d):
    return _seq(spark, d).select("i", scalar.log2_up(F.col("x")).alias("log2_up"))


@query(f"WITH {_S} SELECT i, CAST(CASE WHEN x > 100 THEN ceil(sqrt(x)) ELSE 100 END AS BIGINT) AS granularity FROM s")
def fn_granularity(spark, d):
    return _seq(spark, d).select("i", scalar.granularity(F.col("x")).alias("granularity"))


@query(f"WITH {_L} SELECT vec_id AS id, j AS label, EXISTS (SELECT 1 FROM vl WHERE vl.id = vec_id AND vl.label = j) AS member FROM embeddings, range(24) t(j)")
def fn_bit_test(spark, d):
    rows = labels.label_rows(vec_labels(spark, d))
    every = vectors(spark, d).select("id").join(rows, "id", "left").select("id", scalar.bit_words(F.coalesce("labels", F.array().cast("array<long>")), 1).alias("words"))
    each = every.select("id", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("label"))
    return each.select("id", "label", scalar.bit_test(F.col("words"), F.col("label")).alias("member"))


@query(f"WITH {_S} SELECT count(*) AS n, count(*) AS pairs, count(*) AS lists, true AS in_32_bits, count(*) AS families FROM s")
def fn_hashes(spark, d):
    """Hashes of pairs and of lists differ where their elements or the order of these do; 32-bit hashes fit; families differ."""
    i, x = F.col("i"), F.col("x")
    rows = _seq(spark, d).select(scalar.hash_combine(i, x).alias("p"), scalar.array_hash(F.array(i, x, i)).alias("l"), scalar.hash32(i).between(0, (1 << 32) - 1).alias("h"), (scalar.hash64(i, 1) != scalar.hash64(i, 2)).alias("f"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("p").alias("pairs"), F.countDistinct("l").alias("lists"), F.bool_and("h").alias("in_32_bits"), F.count_if("f").alias("families"))


# sequences


@query("SELECT i, i * i % 97 AS x FROM range(1000) t(i)")
def seq_tabulate(spark, d):
    return sequence.tabulate(spark, 1000, lambda i: i * i % 97)


@query(f"WITH {_S} SELECT i, CAST(coalesce(sum(x) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM s")
def seq_scan_exclusive(spark, d):
    return sequence.scan(_seq(spark, d), block=1000).select("i", "scan")


@query(f"WITH {_S} SELECT i, max(x) OVER (ORDER BY i) AS scan FROM s")
def seq_scan_inclusive_max(spark, d):
    return sequence.scan(_seq(spark, d), "max", True, block=1000).select("i", "scan")


@query(f"WITH {_S} SELECT CAST(sum(x) AS BIGINT) AS s, min(x) AS lo, max(x) AS hi, bit_and(x) AS b_and, bit_or(x) AS b_or, bit_xor(x) AS b_xor, bool_and(x >= 0) AS all_ok, bool_or(x > 998) AS any_ok FROM s")
def seq_reduce_monoids(spark, d):
    return _seq(spark, d).agg(F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.bit_and("x").alias("b_and"), F.bit_or("x").alias("b_or"), F.bit_xor("x").alias("b_xor"), F.bool_and(F.col("x") >= 0).alias("all_ok"), F.bool_or(F.col("x") > 998).alias("any_ok"))


@query(f"WITH {_S} SELECT arg_min(x, i) AS first, arg_max(x, i) AS last, min(x) AS low, max(x) AS high FROM s")
def seq_user_monoid(spark, d):
    """A monoid that doesn't commute: first and last value, and the extremes."""
    kind = "struct<first:bigint,last:bigint,low:bigint,high:bigint>"
    lift = lambda x: F.struct(*[x.cast("long").alias(n) for n in ("first", "last", "low", "high")]).cast(kind)
    both = lambda a, b: F.struct(F.coalesce(a["first"], b["first"]).alias("first"), F.coalesce(b["last"], a["last"]).alias("last"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"))
    zero = F.struct(*[F.lit(None).cast("long").alias(n) for n in ("first", "last", "low", "high")])
    return sequence.fold(_seq(spark, d), zero, lift, both).select("x.*")


@query(f"WITH {_S} SELECT row_number() OVER (ORDER BY i) - 1 AS k, i FROM s WHERE x % 7 = 0")
def seq_pack_index(spark, d):
    return sequence.pack_index(_seq(spark, d), F.col("x") % 7 == 0)


@query(f"WITH {_S} SELECT i, x * 2 AS x FROM s WHERE x % 3 = 1")
def seq_filter_map(spark, d):
    return _seq(spark, d).where("x % 3 = 1").select("i", (F.col("x") * 2).alias("x"))


@query(f"WITH {_S}, t AS (SELECT i, CASE WHEN i > 700 AND x % 5 = 0 THEN x + 1 ELSE x END AS y FROM s), a AS (SELECT x, 0 AS side, i FROM s UNION ALL SELECT y, 1, i FROM t) SELECT row_number() OVER (ORDER BY x, side, i) - 1 AS i, x FROM a")
def seq_merge(spark, d):
    return sequence.merge(_seq(spark, d), _twin(spark, d))


@query(f"WITH {_S} SELECT row_number() OVER (ORDER BY x, i) - 1 AS i, x, i AS was FROM s")
def seq_sort_stable(spark, d):
    return sequence.order_index(_seq(spark, d).select("x", F.col("i").alias("was")), ["x", "was"]).select("i", "x", "was")


@query(f"WITH {_S} SELECT coalesce(min(i) FILTER (WHERE x = 500), count(*)) AS i FROM s")
def seq_find_if(spark, d):
    return sequence.find_first(_seq(spark, d), F.col("x") == 500)


@query(f"WITH {_S} SELECT count(*) AS n, count(*) FILTER (WHERE x < 10) AS n_if FROM s")
def seq_count_if(spark, d):
    return _seq(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("x") < 10).alias("n_if"))


@query(f"WITH {_S} SELECT bool_and(x < 999) AS all_of, bool_or(x = 5) AS any_of, NOT bool_or(x = 5) AS none_of FROM s")
def seq_all_any_none(spark, d):
    s = _seq(spark, d)
    a, b = sequence.quantifiers(s, F.col("x") < 999).select("all_of"), sequence.quantifiers(s, F.col("x") == 5).select("any_of", "none_of")
    return a.join(b)


@query(f"WITH {_S}, n AS (SELECT i, x, lead(x) OVER (ORDER BY i) AS y FROM s) SELECT coalesce(min(i) FILTER (WHERE x = y), count(*)) AS i FROM n")
def seq_adjacent_find(spark, d):
    return sequence.adjacent_find(_seq(spark, d))


def _twin(spark, d):
    return _seq(spark, d).select("i", F.when((F.col("i") > 700) & (F.col("x") % 5 == 0), F.col("x") + 1).otherwise(F.col("x")).alias("x"))


_T = f"WITH {_S}, t AS (SELECT i, CASE WHEN i > 700 AND x % 5 = 0 THEN x + 1 ELSE x END AS y FROM s), p AS (SELECT * FROM s JOIN t USING (i))"


@query(_T + " SELECT coalesce(min(i) FILTER (WHERE x <> y), count(*)) AS i FROM p")
def seq_mismatch(spark, d):
    return sequence.mismatch(_seq(spark, d), _twin(spark, d))


@query(_T + " SELECT count(*) FILTER (WHERE x <> y) = 0 AS equal, coalesce(arg_min(x < y, i) FILTER (WHERE x <> y), false) AS less FROM p")
def seq_lex_compare(spark, d):
    return sequence.compare(_seq(spark, d), _twin(spark, d))


@query(f"WITH {_S}, n AS (SELECT i, x, lead(x) OVER (ORDER BY i) AS y, count(*) OVER () AS n FROM s), w AS (SELECT x AS p, y AS r FROM n WHERE i = 77) SELECT coalesce(min(i) FILTER (WHERE x = p AND y = r), max(n)) AS i FROM n, w")
def seq_search(spark, d):
    s = _seq(spark, d)
    pattern = [r.x for r in s.where("i between 77 and 78").orderBy("i").collect()]
    return sequence.search(s, pattern)


@query(f"WITH {_S}, n AS (SELECT i, x, lead(x) OVER (ORDER BY i) AS y, count(*) OVER () AS n FROM s), w AS (SELECT x AS p, y AS r FROM n WHERE i = 77) SELECT coalesce(max(i) FILTER (WHERE x = p AND y = r), max(n)) AS i FROM n, w")
def seq_find_end(spark, d):
    s = _seq(spark, d)
    pattern = [r.x for r in s.where("i between 77 and 78").orderBy("i").collect()]
    return sequence.search(s, pattern, last=True)


@query(f"WITH {_S}, n AS (SELECT i, x // 300 AS x, lag(x // 300) OVER (ORDER BY i) AS y FROM s) SELECT i, x FROM n WHERE i = 0 OR x <> y")
def seq_unique(spark, d):
    return sequence.unique(_seq(spark, d).select("i", F.expr("x div 300").alias("x")))


@query(f"WITH {_S} SELECT DISTINCT x FROM s")
def seq_remove_duplicates(spark, d):
    return _seq(spark, d).select("x").distinct()


@query(f"WITH {_S} SELECT arg_min(i, (x, i)) AS min_i, arg_min(i, (-x, i)) AS max_i FROM s")
def seq_min_max_element(spark, d):
    return sequence.extremes(_seq(spark, d))


@query(f"WITH {_S}, n AS (SELECT count(*) AS n FROM s) SELECT n - 1 - i AS i, x FROM s, n")
def seq_reverse(spark, d):
    return sequence.reverse(_seq(spark, d))


@query(f"WITH {_S}, n AS (SELECT count(*) AS n FROM s) SELECT (i - 10 + n) % n AS i, x FROM s, n")
def seq_rotate(spark, d):
    return sequence.rotate(_seq(spark, d), 10)


@query(f"WITH {_S}, n AS (SELECT i, x, lag(x) OVER (ORDER BY i) AS y FROM s) SELECT count(*) FILTER (WHERE x < y) = 0 AS is_sorted, coalesce(min(i) FILTER (WHERE x < y), count(*)) AS until FROM n")
def seq_is_sorted(spark, d):
    return sequence.sorted_until(_seq(spark, d))


@query(f"WITH {_S} SELECT coalesce(max(i) FILTER (WHERE x < 900), -1) < coalesce(min(i) FILTER (WHERE NOT x < 900), count(*)) AS partitioned FROM s")
def seq_is_partitioned(spark, d):
    return sequence.is_partitioned(_seq(spark, d), F.col("x") < 900)


@query(f"WITH {_L} SELECT label, unnest(list(id ORDER BY id)) AS id FROM vl GROUP BY label")
def seq_flatten(spark, d):
    rows = labels.label_rows(vec_labels(spark, d))
    return rows.select(F.explode("labels").alias("label"), "id")


@query("WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\f\\r\\v]+')) AS token FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct FROM t WHERE token <> '' GROUP BY doc_id")
def seq_tokens(spark, d):
    return sequence.tokens(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))


@query(f"WITH {_S}, f AS (SELECT i, x, coalesce(sum(CASE WHEN x % 50 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM s) SELECT CAST(part AS BIGINT) AS part, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM f GROUP BY part")
def seq_split_at(spark, d):
    return sequence.split_at(_seq(spark, d), F.col("x") % 50 == 0).withColumn("part", F.col("part").cast("long"))


@query(_T + " SELECT i, x FROM s UNION ALL SELECT i + (SELECT count(*) FROM s), y FROM t")
def seq_append(spark, d):
    s = _seq(spark, d)
    n = s.agg(F.count("*").alias("n"))
    return s.unionByName(_twin(spark, d).join(F.broadcast(n)).select((F.col("i") + F.col("n")).alias("i"), "x"))


@query(_T + " SELECT i, x, y FROM p")
def seq_zip(spark, d):
    return _seq(spark, d).join(_twin(spark, d).withColumnRenamed("x", "y"), "i")


@query(f"WITH {_S} SELECT i, row_number() OVER (ORDER BY x, i) - 1 AS rank FROM s")
def seq_rank(spark, d):
    return sequence.order_index(_seq(spark, d).select("x", F.col("i").alias("was")), ["x", "was"]).select(F.col("was").alias("i"), F.col("i").alias("rank"))


@query(f"WITH {_S} SELECT x FROM s ORDER BY x, i LIMIT 1 OFFSET 100")
def seq_kth_smallest(spark, d):
    return sequence.kth_smallest(_seq(spark, d), 100)


@query(f"WITH {_S} SELECT x % 50 AS k, count(*) AS n, CAST(sum(i) AS BIGINT) AS total, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS members FROM s GROUP BY 1")
def seq_group_by_key(spark, d):
    s = _seq(spark, d).withColumn("k", F.col("x") % 50)
    return s.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("total"), F.sort_array(F.collect_list("i")).alias("m")).select("k", "n", "total", _line(F.col("m")).alias("members"))


@query(f"WITH {_S} SELECT k, CAST(coalesce(sum(i), 0) AS BIGINT) AS total, count(i) AS n FROM range(1500) t(k) LEFT JOIN s ON x = k GROUP BY k")
def seq_histogram_by_index(spark, d):
    return sequence.reduce_by_index(_seq(spark, d).select(F.col("x").alias("k"), F.col("i").alias("x")), 1500)


@query()
def seq_random_shuffle(spark, d):
    return sequence.shuffled(_seq(spark, d), 7)


# preparation


@query("WITH f AS (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY p_brand) SELECT p_brand, row_number() OVER (ORDER BY f, p_brand) - 1 AS code FROM f")
def dict_first_seen(spark, d):
    return prep.first_seen_codes(table(spark, d, "part"), "p_partkey", "p_brand")


@query("SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)")
def dict_sorted(spark, d):
    return prep.sorted_codes(table(spark, d, "part"), "p_type")


@query("WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1 AS x FROM part GROUP BY p_brand), t AS (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS y FROM part GROUP BY p_type) SELECT p_partkey, x * (SELECT count(*) FROM t) + y AS label, (SELECT count(*) FROM b) * (SELECT count(*) FROM t) AS classes FROM part JOIN b USING (p_brand) JOIN t USING (p_type)")
def composite_label(spark, d):
    p = table(spark, d, "part")
    b, t = prep.first_seen_codes(p, "p_partkey", "p_brand"), prep.first_seen_codes(p, "p_partkey", "p_type")
    n = b.agg(F.count("*").alias("nb")).join(t.agg(F.count("*").alias("nt")))
    rows = p.join(F.broadcast(b.withColumnRenamed("code", "x")), "p_brand").join(F.broadcast(t.withColumnRenamed("code", "y")), "p_type").join(F.broadcast(n))
    return rows.select("p_partkey", prep.composite_label([F.col("x"), F.col("y")], [F.col("nb"), F.col("nt")]).alias("label"), (F.col("nb") * F.col("nt")).alias("classes"))


def _all_rows(spark, d):
    r = labels.label_rows(vec_labels(spark, d))
    return vectors(spark, d).select("id").join(r, "id", "left").select("id", F.coalesce("labels", F.array().cast("array<long>")).alias("labels"))


@query(f"WITH {_L} SELECT vec_id AS id, coalesce(string_agg(CAST(vl.label AS VARCHAR), ',' ORDER BY vl.label), '-1') AS line FROM embeddings LEFT JOIN vl ON id = vec_id GROUP BY vec_id")
def label_text_comma(spark, d):
    return _all_rows(spark, d).select("id", prep.label_text(F.col("labels"), 0, "-1").alias("line"))


@query(f"WITH {_L} SELECT vec_id AS id, coalesce(string_agg(CAST(vl.label + 1 AS VARCHAR), ',' ORDER BY vl.label), '25') AS line FROM embeddings LEFT JOIN vl ON id = vec_id GROUP BY vec_id")
def label_text_shifted(spark, d):
    return _all_rows(spark, d).select("id", prep.label_text(F.col("labels"), 1, "25").alias("line"))


@query(f"WITH {_L} SELECT id, label FROM vl")
def label_text_parse(spark, d):
    return prep.parse_label_text(label_text_comma(spark, d))


@query(f"WITH {_L}, n AS (SELECT r AS row, (SELECT count(*) FROM vl WHERE vl.id = r) AS c FROM range((SELECT count(*) + 1 FROM embeddings)) t(r)) SELECT row, CAST(coalesce(sum(c) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def csr_indptr(spark, d):
    n = table(spark, d, "embeddings").count()
    return prep.indptr(vec_labels(spark, d).select(F.col("id").alias("row"), F.col("label").alias("col")), n)


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id < 100")
def limit_prefix(spark, d):
    return table(spark, d, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("id"), "label")


@query("SELECT vec_id // 125 AS shard, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS total FROM embeddings GROUP BY 1")
def shard_iterator(spark, d):
    return table(spark, d, "embeddings").groupBy(F.expr("vec_id div 125").alias("shard")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("total"))


@query("SELECT vec_id AS id, j AS label FROM embeddings, range(20) t(j) WHERE ((vec_id + 1) * (j + 3) * 7919 + vec_id * vec_id * 31 + j * j * 17) % 1009 < 404")
def synthetic_labels(spark, d):
    ids = vectors(spark, d).select("id")
    return prep.bernoulli_labels(ids, 20, F.expr("((id + 1) * (label + 3) * 7919 + id * id * 31 + label * label * 17) % 1009 < 404"))


@query()
def synthetic_distinct_labels(spark, d):
    return prep.distinct_labels(vectors(spark, d).select("id"), 20, F.lit(8), 3, prep.zipf_weights(20))


@query()
def synthetic_vectors(spark, d):
    return prep.random_vectors(spark, 200, 8, 5).select("id", F.posexplode("v").alias("place", "x"))


@query("""WITH x AS (SELECT p_partkey AS id, p_brand, p_size FROM part), b AS (SELECT p_brand, row_number() OVER (ORDER BY min(id), p_brand) - 1 AS cb FROM x GROUP BY p_brand),
m AS (SELECT p_size, row_number() OVER (ORDER BY min(id), p_size) - 1 AS cm FROM x GROUP BY p_size)
SELECT 'base' AS side, id, cb * (SELECT count(*) FROM m) + cm AS label, (SELECT count(*) FROM b) * (SELECT count(*) FROM m) AS classes FROM x JOIN b USING (p_brand) JOIN m USING (p_size)
UNION ALL SELECT 'query', id, cb * (SELECT count(*) FROM m) + cm, (SELECT count(*) FROM b) * (SELECT count(*) FROM m) FROM x JOIN b USING (p_brand) JOIN m USING (p_size) WHERE id % 10 = 0""")
def prepare_attributes(spark, d):
    """Attributes of base rows and queries to one composite label each."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", F.col("p_size").cast("string")).alias("attributes"))
    base, asked, classes = prepare.attribute_labels(rows, rows.where("id % 10 = 0"), 2)
    both = base.withColumn("side", F.lit("base")).unionByName(asked.withColumn("side", F.lit("query")))
    return both.join(F.broadcast(classes)).select("side", "id", "label", "classes")


@query("""WITH c AS (SELECT o_orderkey AS id, unnest([o_orderstatus, o_orderpriority]) AS category FROM orders), k AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS label FROM (SELECT DISTINCT category FROM c))
SELECT DISTINCT 'base' AS side, id, label FROM c JOIN k USING (category) UNION ALL SELECT 'query', c_custkey, label FROM customer JOIN k ON category = chr(CAST(70 + 9 * (c_custkey % 2) AS INTEGER))""")
def prepare_categories(spark, d):
    """Categories of base rows and queries to labels by a sorted dictionary of base's."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("category"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("category"))
    rows, query_rows, _ = prepare.category_labels(base, asked)
    return rows.withColumn("side", F.lit("base")).unionByName(query_rows.withColumn("side", F.lit("query"))).select("side", "id", "label")


@query(_ROUTE + """, m AS (SELECT z.qid, x.id FROM z JOIN vl x ON x.label = z.a WHERE z.b IS NULL OR EXISTS (SELECT 1 FROM vl y WHERE y.label = z.b AND y.id = x.id)),
c AS (SELECT z.qid, z.arity, count(m.id) AS n FROM z LEFT JOIN m ON m.qid = z.qid GROUP BY ALL),
pl AS (SELECT qid, n, row_number() OVER (ORDER BY n, qid) - 1 AS place, count(*) OVER () AS total FROM c)
SELECT 'mixed_query' AS subset, qid, n FROM c UNION ALL SELECT CASE arity WHEN 1 THEN 'single_query' ELSE 'double_query' END, qid, n FROM c
UNION ALL SELECT 'pc' || p || '_query', qid, n FROM pl, (VALUES (1), (25), (50), (75)) t(p) WHERE abs(100 * place / total - p) <= 1""")
def prepare_subsets(spark, d):
    """Queries by their number of labels and by percentiles of specificity."""
    return prepare.query_subsets(_mixed(spark, d), vec_labels(spark, d))


@query(f"WITH {_V}, {_L}, {_Q}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS qid FROM q), g AS ({_topk(_L2U, 'q JOIN vl ON vl.label = q.a JOIN vectors w ON w.id = vl.id', 5)}) SELECT n.qid, n.id AS old_id, n.a AS label, CAST(list_sum(n.u) AS BIGINT) AS total, g.rank, g.id AS near FROM n JOIN g ON g.qid = n.id")
def prepare_subset_files(spark, d):
    """A subset of the queries written as vectors, labels and true neighbours, and read again."""
    folder, q, vl = _file(spark, "prepared"), queries(spark, d, 1, True), vec_labels(spark, d)
    subset = prepare.query_subsets(q, vl).where("subset = 'single_query'").select("qid")
    truth = knn.filtered_knn(q, vl, vectors(spark, d, True), 5, DIM, "long")
    prepare.write_subset(q, truth, subset, folder, "single_query", 24, 5)
    old = prepare.dense_queries(q.select("qid"), subset).select("qid", "old_id")
    read = native.read(spark, f"{folder}/single_query.u8bin", "u8bin", rows=20).select(F.col("id").alias("qid"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    own = native.read(spark, f"{folder}/single_query.metadata.spmat", "spmat", rows=20).select(F.col("row").alias("qid"), F.col("col").alias("label"))
    near = native.read(spark, f"{folder}/single_query_GT.pairs", "pairs", rows=20, dim=5).where("id >= 0").select("qid", "rank", F.col("id").alias("near"))
    return old.join(read, "qid").join(own, "qid").join(near, "qid").select("qid", "old_id", "label", "total", "rank", "near")


@query("SELECT 'base' AS side, count(*) AS n, true AS as_wanted FROM embeddings UNION ALL SELECT 'single', count(*), true FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT 'double', count(*), true FROM embeddings WHERE vec_id % 10 = 3")
def synthetic_sets(spark, d):
    """Synthetic labels of base rows and queries: how many rows, and whether their numbers of labels are right (base: 8 of 20 on average, within 1)."""
    ids = vectors(spark, d).select("id")
    base, single, double = prepare.synthetic_sets(ids, ids.where("id % 10 = 3"), 20, 8)
    counted = lambda rows, at: at.join(rows.distinct().groupBy("id").count(), "id", "left").fillna(0, ["count"])
    asked = ids.where("id % 10 = 3")
    out = counted(base, ids).agg(F.lit("base").alias("side"), F.count("*").alias("n"), F.avg("count").between(7, 9).alias("as_wanted"))
    for name, rows, m in (("single", single, 1), ("double", double, 2)):
        out = out.unionByName(counted(rows, asked).agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.bool_and(F.col("count") == m).alias("as_wanted")))
    return out


@query("SELECT 'base' AS side, CAST(300 AS BIGINT) AS n, CAST(299 AS BIGINT) AS last, true AS same_dim UNION ALL SELECT 'query', 20, 19, true")
def synthetic_points(spark, d):
    """Random points split into base rows and queries, with dense ids each."""
    sides = zip(("base", "query"), prepare.synthetic_points(spark, 300, 20, 8), strict=True)
    parts = [rows.agg(F.lit(name).alias("side"), F.countDistinct("id").alias("n"), F.max("id").alias("last"), F.bool_and(F.size("v") == 8).alias("same_dim")) for name, rows in sides]
    return parts[0].unionByName(parts[1])


@query("SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS known")
def random_query_sample(spark, d):
    """Rows picked at random as queries: as many as asked for, all different, all from the base."""
    rows = vectors(spark, d).select("id")
    picked = prep.random_queries(rows, 50, 7)
    return picked.agg(F.count("*").alias("n")).join(picked.distinct().join(rows, "id", "left_semi").agg(F.count("*").alias("known")))


@query("SELECT count(*) AS n, true AS between_1_and_4, true AS varied FROM embeddings")
def synthetic_label_counts(spark, d):
    """Distinct labels of a random number from 1 to 4 for each row."""
    ids = vectors(spark, d).select("id")
    n = prep.distinct_labels(ids, 20, F.pmod(F.xxhash64(F.lit("count"), "id"), F.lit(4)) + 1, 5).distinct().groupBy("id").count()
    return n.agg(F.count("*").alias("n"), F.bool_and(F.col("count").between(1, 4)).alias("between_1_and_4"), (F.countDistinct("count") == 4).alias("varied"))
