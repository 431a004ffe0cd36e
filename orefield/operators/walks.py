"""Second-order random walks over an undirected graph, for several return and in-out biases at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.operators.embed import md5_number
from orefield.operators.shared_rows import attach, cut

#: Neighbours of a node that are ranked together.
BLOCK = 4096
#: Draws of the first round of a step; a walk whose draws are all rejected draws four times as many in the next.
DRAWS = 8
#: Return and in-out parameters of a sweep.
SWEEP = [(1.0, 1.0), (0.25, 4.0), (4.0, 0.25), (0.5, 2.0)]
c = F.col


def ranked_neighbours(edges: DataFrame, block: int = BLOCK, repeats: bool = False) -> tuple[DataFrame, DataFrame]:
    """(neighbours, degrees) of an undirected graph (a, b), both written: (at, k, b, deg_b) with ranks from 0 for each node, and (a, deg).

    A node's neighbours are dealt by a hash into blocks of about ``block``, ranked there, and blocks follow one another; so a hub's list is never sorted in one task.
    Repeated links don't count, unless ``repeats``: then a link that stands twice is two neighbours.
    """
    some = edges.select("a", "b").filter("a is not null and b is not null")
    edges = cut(some if repeats else some.distinct(), "links")
    degrees = cut(edges.groupBy("a").agg(F.count("*").alias("deg")), "degrees")
    total = edges.count()
    rows = attach(edges, degrees, "a", "deg", total)
    rows = attach(rows, degrees.toDF("b", "deg_b"), "b", "deg_b", total)
    rows = rows.withColumn("block", md5_number("b") % F.ceil(c("deg") / block))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("a", "block").orderBy("b")) - 1)
    sizes = rows.groupBy("a", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("a").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.withColumn("before", before).drop("n"), ["a", "block"])
    return cut(rows.select(c("a").alias("at"), (c("before") + c("r")).alias("k"), "b", "deg_b"), "neighbours", release=True), degrees


def _drawn(seed: int, draw: Column) -> list[Column]:
    """Three numbers of 32 bits for a draw of a walk's step; the step is a column, so that all steps run the same compiled code."""
    text = F.md5(F.concat_ws("|", *[x.cast("string") for x in (F.lit(seed), c("start"), c("walk"), c("setting"), c("step"), draw)]))
    return [F.conv(F.substring(text, i, 8), 16, 10).cast("long") for i in (1, 9, 17)]


def biased_step(walks: DataFrame, neighbours: DataFrame, edges: DataFrame, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """The next node of each walk (start, walk, setting, step, p, q, prev, deg_prev, at, deg), in the same columns; ``step`` is that of the node before.

    Weights are 1/p for going back, 1 for a neighbour of the node before, 1/q else. Draws come from an envelope over these: back with mass 1/p, or one of the node's neighbours by its rank
    with mass max(1, 1/q) each, kept with its weight's share of that and never if it leads back. So a draw is one lookup and one membership, however many neighbours a hub has, and at least
    min(q, 1/q) of the draws are kept; a node with one neighbour goes back at once. The first kept draw counts.
    A round shuffles a walk once with each lookup and once with what its draws came to, kept or not.
    """
    pending, first, taken = walks, 1, []
    left = walks.count()
    most = F.greatest(F.lit(1.0), 1 / c("q"))
    scale, key, was = float(1 << 32), ["start", "walk", "setting"], ["step", "p", "q", "prev", "deg_prev", "at", "deg"]
    while left:
        rows = pending.withColumns({"step": c("step") + 1, "draw": F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1)))})
        a, k, u = _drawn(seed, c("draw"))
        rows = rows.withColumns({"back": (c("deg") == 1) | (a / scale * (1 / c("p") + c("deg") * most) < 1 / c("p")), "k": k % c("deg"), "u": u / scale})
        back = rows.filter("back").select(*key, *was, F.struct("draw", c("prev").alias("nxt"), c("deg_prev").alias("deg_nxt")).alias("kept"))
        on = rows.filter("not back").drop("back").join(neighbours.select("at", "k", c("b").alias("nxt"), c("deg_b").alias("deg_nxt")), ["at", "k"])
        on = on.join(edges.select(c("a").alias("prev"), c("b").alias("nxt"), F.lit(True).alias("close")), ["prev", "nxt"], "left")
        is_kept = (c("nxt") != c("prev")) & (c("u") * most < F.when(c("close"), 1.0).otherwise(1 / c("q")))
        tried = back.unionByName(on.select(*key, *was, F.when(is_kept, F.struct("draw", "nxt", "deg_nxt")).alias("kept")))
        moved = tried.groupBy(*key).agg(*[F.first(x).alias(x) for x in was], F.min("kept").alias("kept"))
        moved = cut(moved.select(*key, *was, c("kept.nxt").alias("nxt"), c("kept.deg_nxt").alias("deg_nxt")), "steps", release=True)
        taken.append(moved.filter("nxt is not null").select(*key, "step", "p", "q", c("at").alias("prev"), c("deg").alias("deg_prev"), c("nxt").alias("at"), c("deg_nxt").alias("deg")))
        pending = moved.filter("nxt is null").select(*key, *was).withColumn("step", c("step") - 1)
        left = pending.count()
        first, draws = first + draws, 4 * draws
    return reduce(DataFrame.unionByName, taken) if taken else walks


def second_order_walks(edges: DataFrame, per_node: int = 5, length: int = 10, settings: list[tuple[float, float]] = SWEEP, seed: int = 0, repeats: bool = False) -> DataFrame:
    """(p, q, start, walk, path): ``per_node`` walks of ``length`` nodes from every node of an undirected graph (a, b), for every (p, q).

    All settings advance together. A walk's state is its last two nodes; nodes are written step by step, and put in a row
    once at the end. Draws are hashes of seed, walk, setting, step and draw, so a lost task draws the same again. Ends that are null and repeated links don't count; no links give no walks.
    With ``repeats``, a link that stands twice is drawn twice as often.
    """
    neighbours, degrees = ranked_neighbours(edges, repeats=repeats)
    links = neighbours.select(c("at").alias("a"), "b")
    kinds = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(float(p)).alias("p"), F.lit(float(q)).alias("q")) for i, (p, q) in enumerate(settings)])
    state = degrees.select(c("a").alias("start"), "deg", F.lit(1).alias("step"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk")).select("start", "walk", "step", "deg", F.inline(kinds))
    places = [state.select("start", "walk", "setting", "p", "q", F.lit(0).alias("step"), c("start").alias("node"))]
    for step in range(1, length):
        if step == 1:
            rows = state.withColumns({"at": c("start"), "k": _drawn(seed, F.lit(1))[1] % c("deg")}).join(neighbours, ["at", "k"])
            state = cut(rows.select("start", "walk", "setting", "step", "p", "q", c("at").alias("prev"), c("deg").alias("deg_prev"), c("b").alias("at"), c("deg_b").alias("deg")), "steps")
        else:
            state = biased_step(state, neighbours, links, seed)
        places.append(state.select("start", "walk", "setting", "p", "q", "step", c("at").alias("node")))
    rows = reduce(DataFrame.unionByName, places).groupBy("setting", "p", "q", "start", "walk").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("path"))
    return rows.select("p", "q", "start", "walk", c("path.node").alias("path"))
