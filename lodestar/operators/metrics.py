"""Recall, cost and logs of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources import native
from lodestar.storage import cut


def recall_per_query(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, hits, wanted, recall: of the true neighbours within rank k, how many were found within rank k."""
    want = truth.where(F.col("rank") <= k).select("qid", "id")
    got = results.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit")).distinct()
    return want.join(got, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hits, wanted, recall over all queries."""
    return recall_per_query(results, truth, k).agg(F.sum("hits").alias("hits"), F.sum("wanted").alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))


def padded_recall(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """recall over k places a query where places that both sides leave empty count as hits."""
    n = queries.select("qid").distinct()
    t = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("t"))
    r = results.where(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("r"))
    h = recall_per_query(results, truth, k).select("qid", "hits")
    every = n.join(t, "qid", "left").join(r, "qid", "left").join(h, "qid", "left").fillna(0)
    return every.agg((F.sum(F.col("hits") + F.least(k - F.col("t"), k - F.col("r"))) / (F.lit(k) * F.count("*"))).alias("recall"))


def violations(results: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Results that lack one of their query's labels; empty for a right search."""
    need = results.join(queries.select("qid", F.explode("qlabels").alias("label")), "qid")
    return need.join(labels, ["id", "label"], "left_anti").select("qid", "id", "label")


def case_stats(log: DataFrame) -> DataFrame:
    """case_name, n, hits, recall, dist_comps of a log (qid, case_name, hits, wanted, dist_comps)."""
    return log.groupBy("case_name").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), (F.sum("hits") / F.sum("wanted")).alias("recall"), F.sum("dist_comps").alias("dist_comps"))


#: Columns of the summary and of the log of queries, in order.
SUMMARY = ("index", "beam_width", "num_clusters", "runtime", "recall", "qps", "avg_dist_comps")
LOG = ("id", "comparisons", "time", "distance_time", "filter_count_a", "filter_count_b", "recall", "case", "iter", "hops", "push", "checks", "pass_filter", "clusters", "filter_time")


def totals(log: DataFrame, k: int) -> DataFrame:
    """n, total_dist_comps, avg_dist_comps, recall over k places a query, of a log (qid, hits, dist_comps)."""
    return log.agg(F.count("*").alias("n"), F.sum("dist_comps").alias("total_dist_comps"), F.avg("dist_comps").alias("avg_dist_comps"), (F.sum("hits") / (k * F.count("*"))).alias("recall"))


def write_summary(rows: DataFrame, path: str) -> None:
    """Appends the columns of SUMMARY to one CSV file, with a header if it is new. Rows are one a setting of a sweep, so they pass the driver."""
    old = native.read_bytes(path) if native.exists(path) else (",".join(SUMMARY) + "\n").encode()
    lines = [",".join("" if x is None else str(x) for x in r) + "\n" for r in rows.select(*SUMMARY).toLocalIterator()]
    native.write_bytes(old + "".join(lines).encode(), path)


def query_log(routes: DataFrame, per_query: DataFrame, cost: DataFrame) -> DataFrame:
    """One row a query: its route (qid, arity, a, size_a, b, size_b, strategy, case_name), hits, wanted and dist_comps."""
    scored = per_query.select("qid", "hits", "wanted")
    out = routes.join(scored, "qid", "left").join(cost.select("qid", "dist_comps"), "qid", "left")
    return out.fillna(0, ["hits", "wanted", "dist_comps"])


def log_table(log: DataFrame) -> DataFrame:
    """The columns of LOG from a query_log, with the counters hops, push, checks, pass_filter and clusters where log has them.

    Queries are answered together, so the times of a single one are unknown: those columns are null, as are absent counters.
    """
    own = {"id": "qid", "comparisons": "dist_comps", "filter_count_a": "size_a", "filter_count_b": "size_b", "recall": "hits", "case": "case_name", "iter": "hops"}
    kinds = {"case": "string", "time": "double", "distance_time": "double", "filter_time": "double"}
    out = [F.col(own.get(c, c)) if own.get(c, c) in log.columns else F.lit(None) for c in LOG]
    out[LOG.index("filter_count_b")] = F.coalesce(F.col("size_b"), F.lit(0))
    return log.select(*[x.cast(kinds.get(c, "long")).alias(c) for c, x in zip(LOG, out, strict=True)])


def case_lines(stats: DataFrame) -> DataFrame:
    """case_name, line: the text log of case_stats, a line a case."""
    line = F.format_string("%s %s recall, %d dist comps, %d total", F.col("case_name"), F.round("recall", 6).cast("string"), F.col("dist_comps"), F.col("n"))
    return stats.select("case_name", line.alias("line"))


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", True).csv(path)


def sweep(run, truth: DataFrame, values: list[int], k: int) -> list[dict]:
    """For each setting (beam width or clusters probed) the runtime, recall and queries a second of run(setting)."""
    import time

    n = truth.select("qid").distinct().count()
    out = []
    for value in values:
        began = time.perf_counter()
        found = cut(run(value), "found")
        seconds = time.perf_counter() - began
        out.append({"setting": value, "runtime": seconds, "qps": n / seconds, "recall": recall(found, truth, k).first().recall})
    return out
