"""Merkle manifest of a dataset by lag and lead windows.

Rows of a group are numbered in order, and runs of ``ARITY`` consecutive nodes hash into their parent
until one node is left.  All rows stay in place while the tree grows: the node over the leaves from
i * arity^l on sits on the first of them, so at level l its neighbours are exactly arity^l rows
away.  Lag and lead columns at these fixed distances, masked by the slot in the run and the run's
length, are the siblings; the rows in slot 0 hash the parents.

Windows are cut into stretches of arity^``LEVELS`` rows, which no run crosses, so a group of any
size spreads over tasks.  A stretch leaves one node, these are numbered like leaves one round up,
and the proofs of the rounds are joined.  The groups' roots are a last list of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise

ARITY = 3
LEVELS = 6
ROWS_IN_TASK = 500_000
PROOF = "array<struct<before: string, after: string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """Add ``i``, the place of a row in its group, and ``of``, the size of the group; ``n`` counts the rows.

    Ranges of (group, order) are dealt to tasks; what lies before a task in its group comes from a table
    with a row per task and group in it.  Equal rows take neighbouring places.
    """
    parts = -(-n // ROWS_IN_TASK) + rows.sparkSession.sparkContext.defaultParallelism
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    place = F.monotonically_increasing_id()
    placed = materialise(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", place))
    placed = placed.withColumns({"_task": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    every = Window.partitionBy(*[F.col(c) for c in group])
    before = F.coalesce(F.sum("_rows").over(every.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*group, "_task", (before - F.col("_first")).alias("_start"), F.sum("_rows").over(every).alias("of"))
    joined = lookup_join(placed, starts, [*group, "_task"], "inner", null_safe=True)
    return joined.withColumn("i", F.col("_place") + F.col("_start")).drop("_place", "_task", "_start")


def _round(nodes: DataFrame, group: list[str], arity: int, levels: int) -> DataFrame:
    """Nodes (group, i, of, d, ...) with ``proof`` within their stretch, its number ``stretch`` and, on its first row, its ``top``."""
    nodes = nodes.withColumn("stretch", F.expr(f"i div {arity**levels}"))
    window = Window.partitionBy(*group, "stretch").orderBy("i")
    steps = []
    for level in range(levels):
        wide = arity**level
        near = {f"_{side}{j}": f("d", j * wide).over(window) for side, f in (("a", F.lead), ("b", F.lag)) for j in range(1, arity)}
        nodes = nodes.withColumns(near)
        place, left = F.expr(f"i div {wide}"), F.expr(f"(of + {wide - 1}) div {wide}")
        slot = place % arity
        run = F.least(F.lit(arity), left - (place - slot))
        before = F.concat(F.lit(""), *[F.when(slot >= j, F.col(f"_b{j}")).otherwise("") for j in reversed(range(1, arity))])
        after = F.concat(F.lit(""), *[F.when(slot + j < run, F.col(f"_a{j}")).otherwise("") for j in range(1, arity)])
        leads = (F.col("i") % wide == 0) & (left > 1)
        nodes = nodes.withColumns({
            f"_s{level}": F.when(leads, F.struct(before.alias("before"), after.alias("after"))),
            "d": F.when(~leads, F.col("d")).when(slot == 0, digest(F.concat("d", after))),
        }).drop(*near)
        steps.append(f"_s{level}")
    spread = {s: F.last(s, ignorenulls=True).over(window) for s in steps}  # to all leaves below a node
    nodes = nodes.withColumns(spread).withColumn("proof", F.filter(F.array(*steps), lambda s: s.isNotNull()))
    return nodes.withColumn("top", F.when(F.col("i") % arity**levels == 0, F.col("d"))).drop(*steps)


def trees(leaves: DataFrame, group: list[str], arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Add ``root`` and ``proof`` to numbered leaves: the columns of ``group``, ``i``, ``of``, ``d``, and any others.

    ``proof`` lists the siblings before and after every node on the way, from the leaf up.  A lone
    leaf is the root and has an empty proof.
    """
    rounds, nodes = [], leaves
    most = leaves.agg(F.max("of")).first()[0] or 0
    while True:
        risen = _round(nodes, group, arity, levels)
        tops = risen.where(F.col("i") % arity**levels == 0)
        tops = tops.select(*group, F.col("stretch").alias("i"), F.expr(f"(of + {arity**levels - 1}) div {arity**levels}").alias("of"), F.col("top").alias("d"))
        nodes = materialise(tops)
        rounds.append(risen.drop("top"))
        most = -(-most // arity**levels)
        if most <= 1:
            break
    known = nodes.select(*group, F.col("i").alias("stretch"), F.col("d").alias("root"), F.lit(None).cast(PROOF).alias("_more"))
    for at, risen in reversed(list(enumerate(rounds))):
        joined = lookup_join(risen, known, [*group, "stretch"], "inner", null_safe=True, kept=at == len(rounds) - 1)
        whole = F.concat("proof", F.coalesce("_more", F.array().cast(PROOF)))
        joined = joined.withColumn("proof", whole).drop("_more", "stretch")
        if at == 0:
            return joined.drop("d")
        known = joined.select(*group, F.col("i").alias("stretch"), "root", F.col("proof").alias("_more"))
    raise AssertionError


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(proof, leaf, lambda d, s: digest(F.concat(s["before"], d, s["after"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(rows: DataFrame, leaf: Column, key: str, group: str, keep: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(key, group, leaf, subroot, root, proof) for every row, and the columns of ``keep``.

    Leaves ascend by ``key`` within their ``group``, rows of equal key by their leaf; the groups' roots ascend by
    group in the order of their bytes.  A null key or group comes first and is one like any other, a
    null text is not an empty one, repeated rows are leaves of their own, and a group of one
    row has that row's leaf for a subroot.  An empty table has an empty manifest.
    """
    made = {"_key": F.col(f"`{key}`"), "_group": F.col(f"`{group}`"), "d": leaf} | {f"_k_{name}": value for name, value in (keep or {}).items()}
    leaves = materialise(rows.select(*[c.alias(n) for n, c in made.items()]))
    placed = numbered(leaves, ["_group"], ["_key", "d"], leaves.count()).withColumn("leaf", F.col("d"))
    below = trees(placed, ["_group"], arity, levels)
    # A row per group; its first leaf carries the root.
    roots = materialise(below.where("i = 0").select("_group", F.col("root").alias("d")))
    tops = numbered(roots.withColumn("_all", F.lit(0)), ["_all"], ["_group"], roots.count())
    above = trees(tops.withColumn("subroot", F.col("d")), ["_all"], arity, levels)
    above = above.select("_group", "subroot", F.col("root").alias("_top"), F.col("proof").alias("_above"))
    joined = lookup_join(below.drop("root"), above, ["_group"], "inner", null_safe=True)
    return joined.select(
        F.col("_key").alias(key), F.col("_group").alias(group), "leaf", "subroot", F.col("_top").alias("root"), F.concat("proof", "_above").alias("proof"),
        *[F.col(f"_k_{name}").alias(name) for name in keep or {}],
    )
