"""Clustered search: k-means of every big label at once, inverted lists, probing.

Tables: points (label, id, v), centroids (label, cid, cv), members (label, id, cid). With integer vectors
(kind int) all sums are exact and centroids are truncated means, so results do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.distance import l2_squared
from lodestar.operators.knn import top_k
from lodestar.plans.cells import met_centroids, rows_at_once, search_cells, whole_kmeans
from lodestar.storage import cut


def points_of(labels: DataFrame, vectors: DataFrame, big: DataFrame) -> DataFrame:
    return labels.join(big.select("label"), "label").join(vectors, "id").select("label", "id", "v")


def first_centroids(points: DataFrame, cluster_size: int) -> DataFrame:
    """The first ceil(n / cluster_size) members by id of each label, cid from 0."""
    sizes = points.groupBy("label").agg(F.ceil(F.count("*") / cluster_size).alias("k"))
    place = (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).cast("long")
    return points.withColumn("cid", place).join(sizes, "label").where("cid < k").select("label", "cid", F.col("v").alias("cv"))


def assign(points: DataFrame, centroids: DataFrame, dim: int, kind: str) -> DataFrame:
    """label, id, cid, dist: the nearest centroid of the label, ties to the smaller cid. Groups of points meet the label's centroids by matrix products."""
    return met_centroids(points, centroids, dim, kind, 1).select("label", "id", "cid", "dist")


def means(points: DataFrame, members: DataFrame, centroids: DataFrame, dim: int, kind: str) -> DataFrame:
    """Means of the members, truncated for integers; a centroid without members stays."""
    sums = points.join(members, ["label", "id"]).groupBy("label", "cid").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long" if kind != "double" else "double")).alias(f"s{i}") for i in range(dim)])
    mean = (lambda i: F.expr(f"s{i} div n")) if kind != "double" else (lambda i: F.col(f"s{i}") / F.col("n"))
    new = sums.select("label", "cid", F.array(*[mean(i).cast(kind) for i in range(dim)]).alias("new"))
    return centroids.join(new, ["label", "cid"], "left").select("label", "cid", F.coalesce("new", "cv").alias("cv"))


def kmeans(points: DataFrame, cluster_size: int, dim: int, kind: str, iterations: int = 500) -> tuple[DataFrame, DataFrame]:
    """(centroids, members): assign, update, and stop once no point has moved since the round before.

    Labels that one group holds run all their rounds there; the others share rounds, and lineage is cut every round.
    """
    most = rows_at_once(dim)
    sizes = points.groupBy("label").agg(F.count("*").alias("n"))
    large = F.broadcast(sizes.where(F.col("n") > most).select("label"))  # few: each has a group's rows at least
    small = cut(whole_kmeans(points.join(large, "label", "left_anti"), cluster_size, kind, iterations), "small")
    centroids = small.where("id is null").select("label", "cid", F.col("cv").cast(f"array<{kind}>").alias("cv"))
    members = small.where("id is not null").select("label", "id", "cid")
    if not sizes.where(F.col("n") > most).limit(1).count():
        return centroids, members
    more = shared_kmeans(points.join(large, "label", "left_semi"), cluster_size, dim, kind, iterations)
    return centroids.unionByName(more[0].select("label", "cid", F.col("cv").cast(f"array<{kind}>").alias("cv"))), members.unionByName(more[1])


def shared_kmeans(points: DataFrame, cluster_size: int, dim: int, kind: str, iterations: int) -> tuple[DataFrame, DataFrame]:
    """kmeans() of all labels at once, each round over all tasks."""
    points = cut(points, "points")
    centroids = cut(first_centroids(points, cluster_size), "centroids")
    members = None
    for _ in range(iterations):
        new = cut(assign(points, centroids, dim, kind).select("label", "id", "cid"), "members")
        moved = members is None or new.join(members.withColumnRenamed("cid", "old"), ["label", "id"]).where("cid <> old").limit(1).count()
        members = new
        if not moved:
            break
        centroids = cut(means(points, members, centroids, dim, kind), "centroids")
    if members is None:
        members = points.select("label", "id", F.lit(0).cast("long").alias("cid"))
    return centroids, members


def inertia(points: DataFrame, centroids: DataFrame, dim: int, kind: str) -> DataFrame:
    """label, inertia: the summed squared distance to the nearest centroid."""
    return assign(points, centroids, dim, kind).groupBy("label").agg(F.sum("dist").alias("inertia"))


def lists(members: DataFrame) -> DataFrame:
    return members.groupBy("label", "cid").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def rank_centroids(queries: DataFrame, centroids: DataFrame, dim: int, kind: str, nprobe: int | None = None) -> DataFrame:
    """qid, label, cid, dist, place (from 1) of the centroids of each query's label, by (distance, cid); of the nprobe nearest, if given."""
    asked = queries.select("label", F.col("qid").alias("id"), F.col("qv").alias("v"))
    met = met_centroids(asked, centroids, dim, kind, nprobe).select(F.col("id").alias("qid"), "label", "cid", "dist", "place")
    if nprobe is not None:
        return met
    return met.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "cid")).cast("long"))


def probe(queries: DataFrame, centroids: DataFrame, members: DataFrame, vectors: DataFrame, k: int, nprobe: int, dim: int, kind: str, passes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, cost) of queries (qid, qv, label[, qlabels]) in their nprobe (at least 1) nearest clusters.

    The rest of the predicate: rows that vectors (id, v[, labels]) lacks do not pass; with qlabels, rows pass that carry all of
    these labels; passes (qid, id), if given, are the only rows that pass. Cost: qid, n_centroids,
    n_passing, n_clusters and their distance computations, centroids and passing rows.
    """
    nprobe = max(1, nprobe)
    sizes = centroids.groupBy("label").agg(F.count("*").alias("n_centroids"))
    ranked = queries.select("qid", "label").join(centroids.select("label", "cid"), "label")  # all clusters, if so many are probed
    if not sizes.where(F.col("n_centroids") <= nprobe).join(queries.select("label").distinct(), "label", "right").where("n_centroids is null").limit(1).count():
        visited = ranked
    else:
        visited = rank_centroids(queries, centroids, dim, kind, nprobe).select("qid", "label", "cid")
    if passes is None:
        found = search_cells(queries, visited, members, vectors, k, dim, kind).select("qid", "id", "dist")
        passing = search_cells(queries, visited, members, vectors, k, dim, kind, only_count=True).groupBy("qid").agg(F.sum("n").alias("n_passing"))
    else:
        pairs = visited.join(members, ["label", "cid"]).select("qid", "id").join(passes.select("qid", "id"), ["qid", "id"], "left_semi")
        found = pairs.join(queries.select("qid", "qv"), "qid").join(vectors, "id").select("qid", "id", l2_squared(F.col("qv"), F.col("v"), dim, kind).alias("dist"))
        passing = pairs.groupBy("qid").agg(F.count("*").alias("n_passing"))
    counts = queries.select("qid", "label").join(sizes, "label").select("qid", "n_centroids", F.least("n_centroids", F.lit(nprobe).cast("long")).alias("n_clusters"))
    cost = counts.join(passing, "qid", "left").select("qid", "n_centroids", F.coalesce("n_passing", F.lit(0)).alias("n_passing"), "n_clusters")
    return top_k(found, k), cost.withColumn("dist_comps", F.col("n_centroids") + F.col("n_passing"))


def complete(queries: DataFrame, found: DataFrame, members: DataFrame, vectors: DataFrame, k: int, dim: int, kind: str) -> DataFrame:
    """qid, rank, id, dist: the k nearest rows of each query (qid, qv, label[, qlabels]) among all its label's clusters, after a search that may have missed some.

    The k-th row found (qid, rank, id, dist) bounds the distance: clusters whose radius rules out a row as near are left out, the
    others are looked at; all of them, where fewer than k rows were found. vectors and qlabels as for probe().
    """
    have = found.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias("ids"), F.max("dist").alias("most"))
    bounds = cut(have.select("qid", F.when(F.size("ids") >= k, F.col("most")).alias("bound")), "bounds")
    return top_k(search_cells(queries.join(bounds, "qid", "left"), None, members, vectors, k, dim, kind).select("qid", "id", "dist"), k)


def near_target(queries: DataFrame, centroids: DataFrame, members: DataFrame, target: int, dim: int, kind: str, passes: DataFrame | None = None, nprobe: int | None = None) -> DataFrame:
    """qid, id of the nearest clusters until they hold more than target ids; the cluster that crosses it is included."""
    if passes is None:
        sizes = members.groupBy("label", "cid").agg(F.count("*").alias("n"))
        ranked = rank_centroids(queries, centroids, dim, kind).join(sizes, ["label", "cid"], "left")
        pool = None
    else:
        pool = queries.select("qid", "label").join(members, "label").join(passes, ["qid", "id"], "left_semi")
        sizes = pool.groupBy("qid", "label", "cid").agg(F.count("*").alias("n"))
        ranked = rank_centroids(queries, centroids, dim, kind).join(sizes, ["qid", "label", "cid"], "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    taken = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= target)
    if nprobe is not None:
        taken = taken.where(F.col("place") <= nprobe)
    if pool is None:
        return taken.select("qid", "label", "cid").join(members, ["label", "cid"]).select("qid", "id")
    return taken.select("qid", "label", "cid").join(pool, ["qid", "label", "cid"]).select("qid", "id")


def predicate(rows: DataFrame, condition: Column) -> DataFrame:
    """vectors for probe() that satisfy any condition on a table of (id, v, ...), or passes on one of (qid, id, ...)."""
    return rows.where(condition)
