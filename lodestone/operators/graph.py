"""A decision graph: its checks, its steps, its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import fresh_path, staged

RESTART = "__restart__"


def violations(nodes: DataFrame, edges: DataFrame, root: DataFrame, faq: DataFrame) -> DataFrame:
    """``rule``, ``node_id`` and ``detail`` of everything wrong; a sound graph gives no row."""
    bad = lambda rows, rule, node, detail: rows.select(F.lit(rule).alias("rule"), F.col(node).alias("node_id"), F.col(detail).cast("string").alias("detail"))
    ends = nodes.where("type = 'terminal'")
    refs = ends.where("answer_source = 'faq_ref'").join(faq.select(F.col("sheet").alias("ref_sheet"), F.col("row").alias("ref_row")), ["ref_sheet", "ref_row"], "left_anti")
    targets = edges.join(nodes.select(F.col("node_id").alias("next_node_id")), "next_node_id", "left_anti")
    return (
        bad(root.join(nodes, "node_id", "left_anti"), "root_missing", "node_id", "node_id")
        .unionByName(bad(nodes.where("key <> node_id"), "key_mismatch", "key", "node_id"))
        .unionByName(bad(edges.groupBy("node_id", "option_id").count().where("count > 1"), "duplicate_option", "node_id", "option_id"))
        .unionByName(bad(ends.where("answer_source IS NULL"), "no_answer", "node_id", "type"))
        .unionByName(bad(ends.where("answer_source = 'scenario_ppt' AND coalesce(answer_text, '') = ''"), "no_text", "node_id", "type"))
        .unionByName(bad(ends.where("answer_source NOT IN ('scenario_ppt', 'faq_ref')"), "unknown_source", "node_id", "answer_source"))
        .unionByName(bad(refs, "dangling_ref", "node_id", "ref_sheet"))
        .unionByName(bad(targets, "dangling_edge", "node_id", "next_node_id"))
    )


def resolve(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``steps`` (node_id, option_id, ...) with ``next_node_id``, or an ``error`` where there is no such option."""
    known = edges.select("node_id", "option_id", "next_node_id").dropDuplicates(["node_id", "option_id"])
    return steps.join(known, ["node_id", "option_id"], "left").withColumn("error", F.when(F.col("next_node_id").isNull(), "invalid_action"))


def options_of(edges: DataFrame) -> DataFrame:
    """The options of each node, in order, as one array."""
    return edges.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "option_id", "label"))), lambda x: F.struct(x["option_id"], x["label"])).alias("options"))


def paths(edges: DataFrame, root: str) -> DataFrame:
    """``node_id``, ``depth`` and ``path`` of every way down from ``root``; restarts are left out.

    The graph is walked level by level, each staged in the shared folder, until
    one has no row; there is no limit to rows or levels.  A way that comes back
    to one of its own nodes would never end and is an error.
    """
    spark = edges.sparkSession
    base = fresh_path(spark, "paths")
    edges.where(F.col("option_id") != RESTART).select("node_id", "next_node_id").write.parquet(f"{base}/edges")
    steps = spark.read.parquet(f"{base}/edges").withColumnRenamed("node_id", "from_id")
    level = spark.range(1).select(F.lit(root).alias("node_id"), F.lit(0).alias("depth"), F.lit(root).alias("path"), F.array(F.lit(root)).alias("nodes"))
    depth, schema = 0, None
    while True:
        level.write.parquet(f"{base}/levels/{depth}")
        schema = schema or level.schema
        level = spark.read.schema(schema).parquet(f"{base}/levels/{depth}")
        if level.isEmpty():
            break
        back = level.where(F.array_contains(F.slice("nodes", 1, F.size("nodes") - 1), F.col("node_id"))).first()
        if back:
            raise ValueError(f"the graph has a cycle: {back['path']}")
        depth += 1
        level = level.join(steps, F.col("node_id") == F.col("from_id")).select(
            F.col("next_node_id").alias("node_id"), F.lit(depth).alias("depth"), F.concat("path", F.lit(">"), "next_node_id").alias("path"), F.concat("nodes", F.array("next_node_id")).alias("nodes")
        )
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/levels").select("node_id", "depth", "path")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node_id`` and ``depth``, the fewest steps from any of ``roots`` (node_id), of every node that can be reached.

    ``edges`` has node_id and next_node_id and may have cycles: a node is left
    out of a level if an earlier one has it.  Each level is staged, and only
    the newest one is joined with the edges, so the walk is as long as the
    graph is deep.
    """
    spark = edges.sparkSession
    steps = staged(edges.select("node_id", "next_node_id").where("node_id IS NOT NULL AND next_node_id IS NOT NULL").distinct(), "steps")
    base, depth, kind = fresh_path(spark, "levels"), 0, "node_id string, depth long"
    roots.select("node_id").where("node_id IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")).write.parquet(f"{base}/level=0")
    while True:
        seen = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(base)
        last = spark.read.schema(kind).parquet(f"{base}/level={depth}")
        if last.isEmpty():
            return seen
        new = last.select("node_id").join(steps, "node_id").select(F.col("next_node_id").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti")
        depth += 1
        new.withColumn("depth", F.lit(depth).cast("long")).write.parquet(f"{base}/level={depth}")


def findings(nodes: DataFrame, edges: DataFrame, roots: DataFrame, ends: DataFrame) -> DataFrame:
    """Each of ``nodes`` (node_id) with its ``depth`` from ``roots``, null if it cannot be reached, and ``dead_end``: it leads nowhere and is none of ``ends``."""
    leads = edges.where("next_node_id IS NOT NULL").select("node_id").distinct().withColumn("leads", F.lit(True))
    rows = nodes.select("node_id").distinct().join(reached(edges, roots), "node_id", "left").join(leads, "node_id", "left")
    stops = ends.select("node_id").distinct().withColumn("stops", F.lit(True))
    return rows.join(stops, "node_id", "left").select("node_id", "depth", (F.col("leads").isNull() & F.col("stops").isNull()).alias("dead_end"))


def cycles(edges: DataFrame) -> DataFrame:
    """``node_id`` and ``component`` of every node that lies on a cycle: the smallest node with which it can reach both ways.

    Round by round, every node takes the smallest name of those that reach it;
    the nodes of one name that also reach the node so called are a strongly
    connected component and leave the graph, and so do nodes that nothing
    leads to or that lead nowhere.  A node that leads to itself only is on a cycle.
    """
    own = edges.select(F.col("node_id").alias("a"), F.col("next_node_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    left = staged(own, "arrows")
    loops = left.where("a = b").select(F.col("a").alias("node_id"), F.col("a").alias("component"))
    left, out = staged(left.where("a <> b"), "arrows"), None
    while True:
        # Ends of no cycle go first, as long as there are any.
        n = left.count()
        while n:
            left = staged(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "arrows")
            before, n = n, left.count()
            if n == before:
                break
        if not n:
            break
        names = staged(left.select(F.col("a").alias("node_id")).distinct().withColumn("name", F.col("node_id")), "names")
        while True:
            passed = left.join(names.withColumnRenamed("node_id", "a"), "a").groupBy(F.col("b").alias("node_id")).agg(F.min("name").alias("passed"))
            newer = staged(names.join(passed, "node_id", "left").select("node_id", F.least("name", F.coalesce("passed", "name")).alias("name"), (F.col("passed") < F.col("name")).alias("changed")), "names")
            names = newer.select("node_id", "name")
            if newer.where("changed").isEmpty():
                break
        named = left.join(names.select(F.col("node_id").alias("a"), F.col("name").alias("name_a")), "a").join(names.select(F.col("node_id").alias("b"), F.col("name").alias("name_b")), "b")
        back = named.where("name_a = name_b").select(F.col("b").alias("node_id"), F.col("a").alias("next_node_id"))
        found = reached(back, names.where("node_id = name").select("node_id")).select("node_id")
        part = staged(names.join(found, "node_id", "left_semi").select("node_id", F.col("name").alias("component")), "component")
        out = part if out is None else out.unionByName(part)
        gone = part.select("node_id")
        left = staged(left.join(gone.withColumnRenamed("node_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("node_id", "b"), "b", "left_anti").select("a", "b"), "arrows")
    if out is None:
        return loops
    many = out.groupBy("component").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("component")
    out = out.join(many, "component", "left_semi").select("node_id", "component")
    return out.unionByName(loops.join(out.select("node_id"), "node_id", "left_anti"))
