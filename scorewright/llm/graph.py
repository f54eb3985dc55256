"""Connected components over edge tables, and joins that stay even on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import scratch, shared_path, written

SALTS = 32
#: A hot key's rows are dealt over so many salts that none has more rows than this, even if all rows have that key.
SALT_ROWS = 1_000_000
#: Rows of two numbers that are small enough to be broadcast.
BROADCAST_ROWS = 200_000


def salts_for(rows: int) -> int:
    return max(SALTS, -(-rows // SALT_ROWS))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour, follows hooks to their ends, twice as far each
    time, and replaces the ends of all edges by these; edges inside a component vanish.  Only nodes smaller
    than all their neighbours are left, at most every other one, whatever the order of a chain's nodes, so rounds
    are few.  Aggregation is partial before each shuffle, and
    joins with hooks are dealt over salts, as contraction makes hubs with many edges.
    """
    spark = edges.sparkSession
    path = shared_path(spark, "components")
    with scratch(spark):  # the tables of its rounds go when the result is written
        left = written(
            edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges"
        )
        hooks: list[tuple[DataFrame, int]] = []
        while not left.isEmpty():
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
            n = hook.count()
            while True:
                for _ in range(2):
                    hook = _further(hook, n).select("node", F.col("far").alias("to"))
                hook = written(hook, "hooks")
                if _further(hook, n).where("far <> to").isEmpty():
                    break
            hooks.append((hook, n))
            at_a = hook.select(F.col("node").alias("a"), F.col("to").alias("x"))
            at_b = hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
            left = lookup(lookup(left, at_a, n, "a", "b"), at_b, n, "b", "a")
            left = written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        if not hooks:
            return written(left.select(F.col("a").alias("node"), F.col("b").alias("component")), "components", path)
        out = hooks[0][0].withColumnRenamed("to", "component")
        for later, n in hooks[1:]:
            out = _onwards(out, later.select("node", F.col("to").alias("component")), n)
        return written(out, "components", path)


def _onwards(nodes: DataFrame, later: DataFrame, n: int) -> DataFrame:
    """``nodes`` (node, component) with the components that ``later`` of n rows, its nodes being components, puts in their place."""
    at = later.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return lookup(nodes, at, n, "component", "node", "left").select("node", F.coalesce("next", "component").alias("component"))


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after ``more`` (node, component), whose nodes are components of ``found`` or nodes that it has not."""
    new = more.join(found.select("node"), "node", "left_anti")
    return _onwards(found, more, more.count()).unionByName(new)


def _further(hook: DataFrame, n: int) -> DataFrame:
    """node, to, and far: where ``to`` is hooked."""
    over = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
    return lookup(hook, over, n, "to", "node").select("node", "to", "far")


def lookup(rows: DataFrame, table: DataFrame, n: int, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` of n rows, one per ``key``: broadcast if n is small, else written and salted."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    rows, table = written(rows, "rows"), written(table, "table")
    return salted_lookup(rows, table, key, by, how, salts_for(rows.count()))


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``) without gathering a hot key's rows.

    Rows are salted by a hash of column ``by``; distinct (key, salt) pairs, at most ``salts`` of a
    key, fetch the table's row, and the rows join their pair.  ``rows`` is read twice.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(salts)).cast("int"))
    pairs = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n")).drop("_n").join(table, key)
    return salted.join(pairs, [key, "_salt"], how).drop("_salt")
