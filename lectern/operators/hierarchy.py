"""Parent-child links of unknown depth, resolved by parallel tree contraction.

Every round rakes all leaves and compresses an independent set of unary nodes, so the number of rounds
is logarithmic in the number of nodes whatever the depth; the recorded contractions are then undone in
reverse order, each by one join against the nodes already resolved. What never contracts to a root is a
cycle: compression shortens it to a node that is its own parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import stored

#: Rounds undone before the result so far is written out, which keeps plans short.
_ROUNDS_PER_CUT = 6


def latest_links(df: DataFrame, node: str, parent: str, order: str | None = None, label: str | None = None) -> DataFrame:
    """One (node, parent, label) row per node: its row of greatest ``order``.

    Rows without a node are no nodes. Equal ``order`` is settled by the least parent, null last, then the
    least label, so repeated rows and ties give one defined row. A parent that is no node becomes null.
    """
    rank = [F.col(order).desc_nulls_last()] if order else []
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    rows = df.where(F.col(node).isNotNull()).select(
        F.col(node).alias("node"), F.col(parent).alias("parent"), name.alias("label"), *([F.col(order)] if order else [])
    )
    by = Window.partitionBy("node").orderBy(*rank, F.col("parent").asc_nulls_last(), F.col("label").asc_nulls_last())
    one = rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("node", "parent", "label")
    known = one.select(F.col("node").alias("_known"))
    return one.join(known, F.col("parent") == F.col("_known"), "left").select("node", F.col("_known").alias("parent"), "label")


def _coin(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def contract(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Contract a (node, parent, label) forest; returns the contractions of each round and the core.

    A contraction is (node, up, below, steps, ids, labels): ``node`` hangs ``steps`` below ``up``; ids and
    labels lie on the way from ``up`` (exclusive) to ``node`` (inclusive). ``below`` is the child that took
    its place when it was compressed, null when it was raked. The core has roots and self-parents only.
    """
    active = stored(
        links.select(
            "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.array("node").alias("ids"), F.array("label").alias("labels")
        )
    )
    rounds: list[DataFrame] = []
    turn = 0
    while not active.where("up is not null and up <> node").isEmpty():
        turn += 1
        children = active.where("up is not null").groupBy(F.col("up").alias("_up")).agg(F.count("*").alias("n"), F.max("node").alias("only"))
        shaped = active.join(children, F.col("node") == F.col("_up"), "left").drop("_up").withColumn("n", F.coalesce("n", F.lit(0)))
        # a chain node gives way when its coin beats those of both neighbours that might give way as well
        chain = F.col("up").isNotNull() & (F.col("up") != F.col("node")) & (F.col("n") == 1)
        mine, above, below = _coin(F.col("node"), turn), _coin(F.col("up"), turn), _coin(F.col("only"), turn)
        gives = (
            chain
            & ((mine > above) | ((mine == above) & (F.col("node") > F.col("up"))))
            & ((mine > below) | ((mine == below) & (F.col("node") > F.col("only"))))
        )
        marked = shaped.withColumn("gives", F.coalesce(gives, F.lit(False)))
        gone = marked.where("gives").select(
            F.col("node").alias("_mid"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("ids").alias("_ids"), F.col("labels").alias("_labels")
        )
        # a leaf whose parent gives way is hung higher now and raked in a later round
        turned = stored(
            marked.join(gone, F.col("up") == F.col("_mid"), "left").withColumn("raked", F.col("up").isNotNull() & (F.col("n") == 0) & F.col("_mid").isNull())
        )
        rounds.append(
            turned.where("raked or gives").select("node", "up", F.when(F.col("gives"), F.col("only")).alias("below"), "steps", "ids", "labels")
        )
        active = turned.where("not raked and not gives").select(
            "node",
            F.coalesce("_up", "up").alias("up"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.when(F.col("_mid").isNull(), F.col("ids")).otherwise(F.concat("_ids", "ids")).alias("ids"),
            F.when(F.col("_mid").isNull(), F.col("labels")).otherwise(F.concat("_labels", "labels")).alias("labels"),
        )
    return rounds, active


def resolve(links: DataFrame) -> DataFrame:
    """Of each node of (node, parent, label): root, depth, state, path_ids, path_labels.

    state ``tree``: root is the root above, depth the steps to it, the path leads from it to the node.
    ``cycle``: the node is its own ancestor; root is the least node of the cycle, depth 0, the path the
    node alone. ``below_cycle``: root is the least node of the cycle above, depth the steps to the
    cycle's first member met, the path leads from that member. An empty input gives an empty result.
    """
    rounds, core = contract(links)
    done = core.select(
        "node",
        F.col("node").alias("anchor"),
        F.lit(0).cast("long").alias("depth"),
        F.col("up").isNotNull().alias("on_cycle"),
        F.col("up").isNotNull().alias("cyclic"),
        F.slice("ids", -1, 1).alias("path_ids"),
        F.slice("labels", -1, 1).alias("path_labels"),
    )
    for k, taken in enumerate(reversed(rounds)):
        above = done.select(*(F.col(c).alias(f"a_{c}") for c in done.columns))
        child = done.select(F.col("node").alias("c_node"), F.col("on_cycle").alias("c_on"))
        on = F.coalesce("c_on", F.lit(False))
        back = stored(
            taken.join(above, F.col("up") == F.col("a_node"))
            .join(child, F.col("below") == F.col("c_node"), "left")
            .select(
                "node",
                F.col("a_anchor").alias("anchor"),
                F.when(on, F.lit(0)).otherwise(F.col("a_depth") + F.col("steps")).alias("depth"),
                on.alias("on_cycle"),
                F.col("a_cyclic").alias("cyclic"),
                F.when(on, F.slice("ids", -1, 1)).otherwise(F.concat("a_path_ids", "ids")).alias("path_ids"),
                F.when(on, F.slice("labels", -1, 1)).otherwise(F.concat("a_path_labels", "labels")).alias("path_labels"),
            )
        )
        # written out, as the next round reads it twice and its plan would double with every round
        done = done.unionByName(back)
        if k % _ROUNDS_PER_CUT == _ROUNDS_PER_CUT - 1:
            done = stored(done)
    least = done.where("on_cycle").groupBy(F.col("anchor").alias("_anchor")).agg(F.min("node").alias("least"))
    return done.join(least, F.col("anchor") == F.col("_anchor"), "left").select(
        "node",
        F.coalesce("least", "anchor").alias("root"),
        "depth",
        F.when(F.col("on_cycle"), "cycle").when(F.col("cyclic"), "below_cycle").otherwise("tree").alias("state"),
        "path_ids",
        "path_labels",
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(node, descendant, steps) for every proper descendant along the resolved paths.

    Of a cycle, its members have the nodes that hang below them as descendants; the members' mutual
    ancestry is told by their state. One row per pair, never a collected list: the closure is exploded
    from each path where it lies.
    """
    return resolved.where(F.size("path_ids") > 1).select(
        F.posexplode("path_ids").alias("at", "node"), F.col("node").alias("descendant"), (F.size("path_ids") - 1).alias("_last")
    ).where("at < _last").select("node", "descendant", (F.col("_last") - F.col("at")).cast("long").alias("steps"))
