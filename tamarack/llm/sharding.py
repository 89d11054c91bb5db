"""Balanced label propagation: shards of linked documents.

Nodes are groups of equal texts, as heavy as they have documents; links join groups that share their least sentence
under one of ``SKETCHES`` hash functions (near copies mostly do, and documents with many sentences in common), each
through the least group of that sentence. Nodes start in shards by hash and move, round by round, to the shard most of their
neighbours' weight is in. Quotas bound what a shard takes in a round; which movers get in is decided by hash seats,
counted in a table of bounded size, so no shard's movers are ranked in one task. A seat is admitted or refused as a whole, and
a node is never parted here. Leaders (no smaller neighbour) and followers move in turn, so a star does not swing to and fro; when
a leader's and a follower's turn have moved nobody, the rounds end. At last all documents are put in order of (label, leader, group, id) and cut into
equal stretches: counts differ by one at most, and only groups across a cut or larger than a shard are parted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS, ROUNDS, SLACK, SEATS = 40, 8, 1.25, 1024
SKETCHES, SENTENCE = 2, 40  # hash functions; characters of a sentence that counts


def propagate(spark: SparkSession, nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, label, lead): labels 0 to shards - 1 of all ``nodes(node, weight)`` that have an edge in ``edges(a, b)``, and the least node among each one's neighbours and itself; the others keep their hash label.

    ``weight`` may be missing (1 each). Self loops, repeated edges and edges with a null end or one that is no node don't count.
    """
    if "weight" not in nodes.columns:
        nodes = nodes.withColumn("weight", F.lit(1))
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    nodes = nodes.filter("node is not null").groupBy("node").agg(F.max("weight").cast("long").alias("weight"))
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b"), F.col("weight").alias("w")), "b")
    both = Scratch(spark, both, "edges", "snappy")
    near = both.df.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("lead"))
    state = Scratch(spark, near.join(nodes, "node").withColumn("label", start).withColumn("moved", F.lit(False)), "labels", "snappy")
    alone = nodes.join(near.select("node"), "node", "left_anti").groupBy(start.alias("label")).agg(F.sum("weight").alias("fixed"))
    alone = Scratch(spark, alone, "fixed", "snappy")
    total = alone.df.agg(F.coalesce(F.sum("fixed"), F.lit(0))).first()[0] + state.df.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    room = max(1, int(total * SLACK / shards))
    every = spark.range(shards).select(F.col("id").cast("int").alias("label"))
    quiet = 0
    for turn in range(rounds):
        votes = both.df.join(state.df.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("n"))
        own = state.df.select("node", "label", F.lit(0).cast("long").alias("n"), F.lit(1).alias("own"))  # its own shard decides ties only
        votes = votes.withColumn("own", F.lit(0)).union(own).groupBy("node", "label").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", "own", (-F.col("label")).alias("k"))).alias("v")).select("node", (-F.col("v.k")).alias("to"))
        leader = F.col("lead") == F.col("node")
        turns = leader if turn % 2 == 0 else ~leader
        movers = state.df.join(best, "node").filter(turns & (F.col("to") != F.col("label")) & (F.col("weight") <= room))
        movers = movers.withColumn("seat", F.pmod(F.xxhash64("lead", F.lit(turn)), F.lit(SEATS)).cast("int"))
        held = state.df.groupBy("label").agg(F.sum("weight").alias("here"))
        quota = every.join(F.broadcast(held), "label", "left").join(F.broadcast(alone.df), "label", "left").select(
            F.col("label").alias("to"), F.greatest(F.lit(0), F.lit(room) - F.coalesce("here", F.lit(0)) - F.coalesce("fixed", F.lit(0))).alias("quota")
        )
        # quota: a row for each shard; seats: at most shards x SEATS rows. Small seats come first, so one that can't fit keeps no other out
        seats = movers.groupBy("to", "seat").agg(F.sum("weight").alias("n")).join(F.broadcast(quota), "to")
        light = F.when(F.col("n") <= room, F.col("n")).otherwise(0)
        taken = F.sum(light).over(Window.partitionBy("to").orderBy("n", "seat").rowsBetween(Window.unboundedPreceding, 0))
        # a seat larger than a shard goes in: it has to be parted anyway, and the last cut parts it least
        seats = seats.withColumn("taken", taken).filter((F.col("n") > room) | (F.col("taken") <= F.col("quota")))
        admitted = movers.join(F.broadcast(seats.select("to", "seat")), ["to", "seat"])
        after = state.df.drop("moved").join(admitted.select("node", "to"), "node", "left").select("node", "lead", "weight", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved"))
        new = Scratch(spark, after, "labels", "snappy")
        state.drop()
        state = new
        quiet = 0 if state.df.filter("moved").head(1) else quiet + 1
        if quiet == 2:
            break
    both.drop()
    alone.drop()
    return state.df.select("node", "label", "lead")


def cut_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(edges, cut): how many of ``edges(a, b)`` there are between the nodes of ``placed(node, shard)``, and how many of them join two shards."""
    one, two = (placed.select(F.col("node").alias(n), F.col("shard").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return edges.join(one, "a").join(two, "b").agg(F.count("*").alias("edges"), F.count_if(F.col("x") != F.col("y")).alias("cut"))


def text_groups(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(doc_id, size, text_crc32, text_md5)`` of all documents, the groups of equal texts ``groups(node, text_md5, weight)`` and their links ``edges(a, b)``."""
    text = F.col("text").cast("string")
    raw = text.cast("binary")
    sentences = F.filter(F.split(text, r"[.!?\n]+"), lambda x: F.length(x) >= SENTENCE)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.md5(raw).alias("text_md5"),
        sentences.alias("sentences"),
    )
    keys = [F.array_min(F.transform("sentences", lambda x, j=j: F.xxhash64(x, F.lit(j)))).alias(f"k{j}") for j in range(SKETCHES)]
    rows = Scratch(spark, rows.select("doc_id", "size", "text_crc32", "text_md5", *keys), "rows", "snappy").df
    some = rows.filter("text_md5 is not null")
    groups = some.groupBy("text_md5").agg(F.count("*").alias("weight"), *[F.min(f"k{j}").alias(f"k{j}") for j in range(SKETCHES)])
    groups = Scratch(spark, groups.withColumn("node", F.monotonically_increasing_id()), "groups", "snappy").df  # numbered once
    edges = None
    for j in range(SKETCHES):
        own = groups.filter(f"k{j} is not null").select("node", F.col(f"k{j}").alias("key"))
        hubs = own.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
        one = own.join(hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        edges = one if edges is None else edges.union(one)
    return rows, groups, Scratch(spark, edges.distinct(), "links", "snappy").df


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``rows``.

    Equal texts are one group, whatever their ids. Null texts have no bytes, the checksum of the empty text, no group
    and no links. Repeated rows stay rows of their own. Slots count from 0 without gaps in each shard. Texts are taken whole at
    any length. Other columns are ignored.
    """
    rows, groups, edges = text_groups(spark, docs)
    return _cut_even(spark, rows, groups, propagate(spark, groups.select("node", "weight"), edges, shards), shards)


def _cut_even(spark: SparkSession, rows: DataFrame, groups: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """All rows in order of (label, leader, group, id), cut into equal stretches."""
    named = groups.select("node", "text_md5").join(labels, "node", "left")
    named = named.select("text_md5", F.coalesce("label", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).alias("label"), F.coalesce("lead", "node").alias("lead"))
    alone = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    placed = rows.drop(*[f"k{j}" for j in range(SKETCHES)]).join(named, "text_md5", "left").withColumn("label", F.coalesce("label", alone))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["label", "lead", "text_md5", "doc_id"]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = Scratch(spark, ranged, "ranged", "snappy").df
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each range
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    first = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", first.alias("first"), total.alias("total"))
    p = F.col("first") + F.col("at") - F.shiftleft(F.col("part"), 33)
    done = ranged.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("p", p)
    done = done.withColumn("shard", F.expr(f"((p + 1) * {shards} - 1) div total")).withColumn("slot", F.expr(f"p - (shard * total) div {shards}"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_balanced_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, equal texts together."""
    return shard_documents(spark, table(spark, sf_dir, "documents"))
