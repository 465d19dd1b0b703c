import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import distance
from lodestar.operators import blocks, knn, labels, metrics
from lodestar.plans import hybrid_graph, ivf, router
from lodestar.schema import SearchConfig


def make(spark, n=60, dim=4, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 6, (n, dim)).astype(float)
    tags = {i: [j for j in range(3) if rng.random() < 0.6] for i in range(n)}
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "id long, v array<double>")
    rel = spark.createDataFrame([(i, j) for i, t in tags.items() for j in t], "id long, label long")
    return v, tags, vectors, rel


def brute(v, tags, query, need, k):
    rows = [(float(((v[i] - query) ** 2).sum()), i) for i in range(len(v)) if set(need) <= set(tags[i])]
    return [i for _, i in sorted(rows)[:k]]


def test_filtered_knn_ties_short_and_empty(spark):
    v, tags, vectors, rel = make(spark)
    asked = [(0, [0]), (1, [0, 1]), (2, [0, 1, 2]), (3, [9]), (4, [1, 1])]
    queries = spark.createDataFrame([(q, v[q].tolist(), need) for q, need in asked], "qid long, qv array<double>, qlabels array<long>")
    got = {}
    for r in knn.filtered_knn(queries, rel, vectors, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: brute(v, tags, v[q], need, 5) for q, need in asked if brute(v, tags, v[q], need, 5)}
    short = knn.filtered_knn(queries, rel.where("id < 3"), vectors, 5)
    assert short.groupBy("qid").count().agg(F.max("count")).first()[0] <= 3
    assert knn.filtered_knn(queries.limit(0), rel, vectors, 5).count() == 0


def test_routed_search_is_exact_and_cases(spark):
    v, tags, vectors, rel = make(spark)
    queries = spark.createDataFrame([(q, v[q].tolist(), need) for q, need in [(0, [0]), (1, [0, 2]), (2, [1, 2])]], "qid long, qv array<double>, qlabels array<long>")
    for big, pre in ((10, 100), (10, 1), (1000, 1)):
        cfg = SearchConfig(k=4, big_cutoff=big, precomp_cutoff=pre)
        got = router.routed_search(queries, rel, vectors, cfg).select("qid", "rank", "id")
        want = knn.filtered_knn(queries, rel, vectors, 4).select("qid", "rank", "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    names = {r.strategy for r in router.route(queries, rel, SearchConfig(big_cutoff=10, precomp_cutoff=100)).collect()}
    assert names == {"hybridgraph", "precomp"}


def test_label_size_at_cutoff_is_not_big(spark):
    rel = spark.createDataFrame([(i, 0) for i in range(5)] + [(i, 1) for i in range(6)], "id long, label long")
    assert [(r.label, r.ordinal) for r in labels.big_labels(rel, 5).collect()] == [(1, 0)]
    stats, postings = labels.pair_cache(rel, 1, 5)
    assert [tuple(r) for r in stats.collect()] == [(0, 1, 5, False)] and postings.count() == 5
    assert labels.pair_cache(rel, 1, 4)[1].count() == 0


def test_distances(spark):
    row = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = row.select(distance.l2_squared(a, b), distance.l2_squared(a, b, 2), distance.l2(a, b), distance.negative_inner_product(a, b), distance.l2_early_stop(a, b, F.lit(10))).first()
    assert tuple(got) == (25.0, 25.0, 5.0, -0.0, 16.0)


def test_kmeans_edge_cases(spark):
    points = spark.createDataFrame([(0, i, [x, x]) for i, x in enumerate([0, 1, 10, 11])], "label long, id long, v array<int>")
    centroids, members = ivf.kmeans(points, 100, 2, "int")
    assert [r.cv for r in centroids.collect()] == [[5, 5]] and members.count() == 4
    own, _ = ivf.kmeans(points, 1, 2, "int")
    assert sorted(r.cv[0] for r in own.collect()) == [0, 1, 10, 11]
    same = points.withColumn("v", F.array(F.lit(3), F.lit(3)))
    kept, members = ivf.kmeans(same, 2, 2, "int")
    assert kept.count() == 2 and {r.cid for r in members.collect()} == {0}


def test_hybrid_graph_structure_and_recall(spark):
    v, tags, vectors, rel = make(spark, n=120, dim=6, seed=3)
    cfg = SearchConfig(k=5, big_cutoff=10, cluster_size=40, nprobe=3, beam=30, build_candidates=20, degrees=((1 << 62, 8),), shared_degree=4)
    points = ivf.points_of(rel, vectors, labels.big_labels(rel, cfg.big_cutoff))
    centroids, members = ivf.kmeans(points, cfg.cluster_size, 6, "double", 5)
    single, shared, entries = hybrid_graph.build(points, centroids, members, rel, vectors, cfg, 6)
    assert single.where("src = dst").count() == 0 and single.groupBy("label", "src").count().agg(F.max("count")).first()[0] <= 8
    assert shared.groupBy("src").count().agg(F.max("count")).first()[0] <= 4
    queries = spark.createDataFrame([(q, v[q].tolist(), [q % 3]) for q in range(20)], "qid long, qv array<double>, qlabels array<long>")
    found = hybrid_graph.search(queries.withColumn("label", F.col("qlabels")[0]), single, shared, entries, rel, vectors, cfg)
    truth = knn.filtered_knn(queries, rel, vectors, 5)
    assert metrics.violations(found, queries, rel).count() == 0
    assert metrics.recall(found, truth, 5).first().recall >= 0.9
    assert all(r.hops <= r.pushed <= r.dist_comps for r in found.collect())
    approximate = router.indexed(rel, vectors, (centroids, members), (single, shared, entries), cfg, 6, "double")
    mixed = queries.unionByName(queries.withColumn("qid", F.col("qid") + 100).withColumn("qlabels", F.array((F.col("qid") % 2).cast("long"), F.lit(2).cast("long"))))
    routed = router.routed_search(mixed, rel, vectors, cfg, 6, "double", approximate)
    exact = knn.filtered_knn(mixed, rel, vectors, 5)
    assert metrics.violations(routed, mixed, rel).count() == 0 and metrics.recall(routed, exact, 5).first().recall >= 0.9
    few = SearchConfig(**{**vars(cfg), "graph_rows": 5})
    rerouted = router.indexed(rel, vectors, (centroids, members), (single, shared, entries), few, 6, "double")["hybridgraph"](router.route(queries, rel, few).join(queries, "qid"))
    assert metrics.recall(rerouted, truth, 5).first().recall >= 0.5
    with pytest.raises(ValueError):
        hybrid_graph.search(queries.withColumn("label", F.col("qlabels")[0]), single, shared, entries, rel, vectors, few)
    assert metrics.padded_recall(truth, truth, queries, 5).first()[0] == 1


@pytest.mark.parametrize("kind", ["long", "double"])
def test_sparse_products_meet_in_groups(spark, monkeypatch, kind):
    """Several groups, frequent, rare, absent and repeated columns, negative values and large sums; no join makes pairs."""
    monkeypatch.setattr(blocks, "GROUP_ENTRIES", 40)
    rng = np.random.default_rng(7)
    scale = (1 << 26) if kind == "long" else 0.5
    rows = [(i, f"c{int(c)}", int(x) * scale) for i in range(60) for c, x in zip(rng.zipf(1.5, 8) % 30, rng.integers(-4, 5, 8), strict=True) if x]
    asked = [(q, c, x) for q, c, x in rows if q % 10 == 0] + [(999, "nowhere", scale)]
    lists = lambda x: [(i, [c for j, c, _ in x if j == i], [y for j, _, y in x if j == i]) for i in sorted({i for i, *_ in x})]
    schema = f"long, cols array<string>, vals array<{kind}>"
    got = knn.sparse_mips(spark.createDataFrame(lists(asked), f"qid {schema}"), spark.createDataFrame(lists(rows[:99]) + lists(rows[99:]), f"id {schema}"), 4)
    want = {}
    for q, c, x in asked:
        for i, d, y in rows:
            if c == d:
                want[q, i] = want.get((q, i), 0) + x * y
    best = {q: sorted((-d, i) for (p, i), d in want.items() if p == q)[:4] for q in {q for q, _ in want}}
    found = {}
    for r in got.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append((-r.dist, r.id))
    assert found == best
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "double"])
def test_clusters_meet_queries_in_groups(spark, monkeypatch, kind):
    """Labels beyond a group, split clusters and batches give what one group gives, and what brute force gives; no join makes pairs."""
    v, tags, vectors, rel = make(spark, n=90, dim=4, seed=5)
    vectors = vectors.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    points = ivf.points_of(rel, vectors, labels.big_labels(rel, 1))
    asked = [(q, v[q].tolist(), q % 3, [(q + 1) % 3]) for q in range(0, 90, 7)]
    queries = spark.createDataFrame(asked, "qid long, qv array<double>, label long, qlabels array<long>").withColumn("qv", F.col("qv").cast(f"array<{kind}>"))
    tagged = vectors.join(labels.label_rows(rel), "id")
    seen = []
    for size in (64 << 20, 8 * 4 * 7):
        monkeypatch.setattr(blocks, "GROUP_BYTES", size)
        centroids, members = ivf.kmeans(points, 12, 4, kind, 3)
        ranks = ivf.rank_centroids(queries, centroids, 4, kind)
        some, every = (ivf.probe(queries, centroids, members, tagged, 5, n, 4, kind) for n in (2, 100))
        passes = queries.select("qid", F.explode("qlabels").alias("label")).join(rel, "label").select("qid", "id")
        for n, (found, cost) in ((2, some), (100, every)):
            plain, plain_cost = ivf.probe(queries.drop("qlabels"), centroids, members, vectors, 5, n, 4, kind, passes)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
            assert sorted(map(tuple, cost.collect())) == sorted(map(tuple, plain_cost.collect()))
        got = {}
        for r in every[0].orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == {q: brute(v, tags, v[q], [a, *b], 5) for q, _, a, b in asked}
        near = ivf.rank_centroids(queries, centroids, 4, kind, 2)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, ranks.where("place <= 2").collect()))
        own = {(r.label, r.cid): r.cv for r in centroids.collect()}
        for r in ivf.assign(points, centroids, 4, kind).collect():
            assert (r.dist, r.cid) == min((sum((x - y) ** 2 for x, y in zip(v[r.id], c, strict=True)), j) for (label, j), c in own.items() if label == r.label)
        seen.append(([sorted(map(repr, x.collect())) for x in (centroids, members)]))
    if kind == "long":
        assert seen[0] == seen[1]


def test_occlusion_and_overlap_equal_brute_force(spark):
    def plain(dist, vectors, degree, alpha, blockers):
        kept = []
        for a in (1.0, alpha):
            for i in range(len(dist)):
                if len(kept) < degree and i not in kept and all(a * ((x - vectors[i]) ** 2).sum() > dist[i] for x in [*vectors[kept], *blockers]):
                    kept.append(i)
        return sorted(kept)

    rng = np.random.default_rng(2)
    for n in range(1, 60):
        x = rng.integers(0, 5, (n, 3)).astype(float)
        dist = (x**2).sum(1)
        x, dist = x[np.argsort(dist, kind="stable")], np.sort(dist)
        blockers = rng.integers(0, 5, (n % 3, 3)).astype(float)
        assert hybrid_graph.occlusion_prune(dist, x, 6, 1.2, blockers) == plain(dist, x, 6, 1.2, blockers)

    v, tags, vectors, rel = make(spark, n=60, dim=4, seed=8)
    cfg = SearchConfig(big_cutoff=1, cluster_size=10, nprobe=2, build_candidates=5)
    points = ivf.points_of(rel, vectors, labels.big_labels(rel, 1))
    centroids, members = ivf.kmeans(points, cfg.cluster_size, 4, "double", 3)
    found = hybrid_graph.candidates(points, centroids, members, cfg, 4, rel)
    told = {(r.src, r.dst): r.overlap for r in found.collect()}
    assert told == {(a, b): len(set(tags[a]) & set(tags[b])) for a, b in told}
    known = labels.overlap(rel, found.select("src", "dst").distinct())
    assert told == {(r.src, r.dst): r.overlap for r in known.collect()}
    want = sorted(map(tuple, hybrid_graph.shared_candidates(found.drop("overlap"), rel, 2).collect()))
    assert sorted(map(tuple, hybrid_graph.shared_candidates(found, rel, 2).collect())) == want


def test_routed_index_misses_no_neighbour(spark, monkeypatch):
    """Narrow probes and beams, islands, copies, split clusters and several groups: the routed index still gives what exact search gives."""
    monkeypatch.setattr(blocks, "GROUP_BYTES", 8 * 6 * 50)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(120, 6)), rng.normal(size=(60, 6)) + 40, np.tile(np.full(6, 7.5), (70, 1))])
    rel = spark.createDataFrame([(i, j) for i in range(len(v)) for j in range(3) if rng.random() < 0.6], "id long, label long")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    cfg = SearchConfig(k=5, big_cutoff=10, precomp_cutoff=5, cluster_size=20, nprobe=1, beam=5, build_candidates=4, degrees=((1 << 62, 3),), shared_degree=1, graph_rows=140)
    points = ivf.points_of(rel, vectors, labels.big_labels(rel, cfg.big_cutoff))
    lists = ivf.kmeans(points, cfg.cluster_size, 6, "double", 2)
    graph = hybrid_graph.build(points, *lists, rel, vectors, cfg, 6)
    asked = [(q, v[q].tolist(), [q % 3]) for q in range(0, 250, 7)] + [(1000 + q, (v[q] + 0.5).tolist(), [q % 3, (q + 1) % 3]) for q in range(0, 250, 7)]
    queries = spark.createDataFrame(asked, "qid long, qv array<double>, qlabels array<long>")
    routed = router.routed_search(queries, rel, vectors, cfg, 6, "double", router.indexed(rel, vectors, lists, graph, cfg, 6, "double"))
    assert {r.strategy for r in routed.select("strategy").distinct().collect()} == {"hybridgraph", "ivf"}
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.dist, 9)) for r in df.collect())
    assert rows(routed) == rows(knn.filtered_knn(queries, rel, vectors, 5))
    nothing = routed.limit(0).select("qid", "rank", "id", "dist")
    label = queries.where("size(qlabels) = 1").select("qid", "qv", F.col("qlabels")[0].alias("label"))
    assert rows(ivf.complete(label, nothing, lists[1], vectors, 5, 6, "double")) == rows(knn.filtered_knn(queries.where("qid < 1000"), rel, vectors, 5))
