"""Sampling by keyed hash, exclusion, clustering over shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.session import materialize


def keyed_hash(seed: str, item: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.lit(seed), "UTF-8"), F.unhex(F.lit("00")), F.encode(item.cast("string"), "UTF-8")), 256)


def stratified(rows: DataFrame, stratum: str, item: str, seed: str, quota: int, reserve: int = 0) -> DataFrame:
    """The first ``quota`` of each stratum by keyed hash, then ``reserve`` more numbered from 1.

    A row_number with a constant bound is planned as a top-k in each task before the shuffle, so a hot
    stratum sends at most quota + reserve rows from each task.
    """
    w = Window.partitionBy(stratum).orderBy(keyed_hash(seed, F.col(item)), F.col(item))
    ranked = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= quota + reserve)
    return ranked.withColumn("selected", F.col("position") <= quota).withColumn("reserve_position", F.when(F.col("position") > quota, F.col("position") - quota))


def exclusion_reasons(rows: DataFrame, lists: dict[str, DataFrame], item: str) -> DataFrame:
    """Names of the id lists (single column ``item``) that hold each row."""
    out = rows
    for name, ids in lists.items():
        out = out.join(ids.select(item).distinct().withColumn(f"__{name}", F.lit(name)), item, "left")
    return out.withColumn("reasons", F.array_compact(F.array(*[F.col(f"__{n}") for n in lists]))).drop(*[f"__{n}" for n in lists])


def token_clusters(tokens: DataFrame) -> DataFrame:
    """G1: (item, cluster) of items that share tokens, directly or in a chain; a cluster is named by its smallest item.

    tokens (item long, token string). Items of a token meet its smallest item, not each other. Each
    round every item takes the least label around it, then the label of its label; rounds are written
    to the shared folder. Null items and tokens take no part.
    """
    rows = tokens.select(F.col("item").cast("long").alias("item"), "token").filter("item is not null and token is not null").distinct()
    hubs = rows.groupBy("token").agg(F.min("item").alias("hub"))
    edges = rows.join(hubs, "token").filter("item != hub").select(F.col("item").alias("a"), F.col("hub").alias("b")).distinct()
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cluster-edges")
    labels = materialize(rows.select("item").distinct().withColumn("label", F.col("item")), "cluster-labels")
    while True:
        around = edges.join(labels.select(F.col("item").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(around.withColumnRenamed("a", "item"), "item", "left").select("item", F.least("label", "near").alias("new"), "label")
        up = stepped.select(F.col("item").alias("new"), F.col("new").alias("up"))
        jumped = materialize(stepped.join(up, "new", "left").select("item", F.least("new", "up").alias("new"), "label"), "cluster-labels")
        changed = not jumped.filter("new != label").isEmpty()
        labels = jumped.select("item", F.col("new").alias("label"))
        if not changed:
            return labels.select("item", F.col("label").alias("cluster"))


def cluster_survivors(items: DataFrame, clusters: DataFrame, stratum: str) -> DataFrame:
    """G1: a cluster of mixed strata is rejected whole; else its smallest item stays and the rest go to the ledger."""
    both = items.join(clusters, "item")
    per = both.groupBy("cluster").agg(F.count_distinct(F.coalesce(F.col(stratum), F.lit("__null__"))).alias("strata"), F.min("item").alias("keeper"))
    decision = F.when(F.col("strata") > 1, "rejected_conflict").when(F.col("item") == F.col("keeper"), "kept").otherwise("rejected_duplicate")
    return both.join(per, "cluster").withColumn("decision", decision).drop("strata")


def quota_contract(selected: DataFrame, stratum: str, quotas: dict[str, int]) -> DataFrame:
    """Strata whose number of selected rows is not their quota; no row means the contract holds."""
    want = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    names = selected.sparkSession.createDataFrame([(k,) for k in quotas], f"{stratum} string")
    have = selected.filter("selected").groupBy(stratum).agg(F.count("*").alias("have"))
    return names.join(have, stratum, "full").withColumn("want", F.coalesce(want[F.col(stratum)], F.lit(0))).withColumn("have", F.coalesce("have", F.lit(0))).filter("have != want")
