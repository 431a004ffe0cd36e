"""Integer graphs, negatives, walks, propagation and evaluation of entity vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import vectors as V
from orefield.operators.neighbours import distances_by_class, nearest_by_cosine, whole
from orefield.operators.shared_rows import attach, cut


def md5_number(*keys: Column | str) -> Column:
    """32 bits of the md5 of the keys, the same in any engine."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dense_ids(terms: DataFrame, term: str, name: str = "id") -> DataFrame:
    """(term, id): 0..n-1 for the distinct terms. They are ranked within 4096 buckets of their md5, so no task sees all of them."""
    rows = terms.select(term).filter(F.col(term).isNotNull()).distinct().withColumn("__b", F.conv(F.substring(F.md5(F.col(term).cast("string")), 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__b", before.alias("__o"))  # at most 4096 rows
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(term)) - 1
    return rows.withColumn("__r", rank).join(F.broadcast(offsets), "__b").select(term, (F.col("__o") + F.col("__r")).alias(name))


def index_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(h, r, t) of triples (s, p, o) by the ids of ``entities`` (term, id) and ``relations`` (term, id)."""
    e, r = entities.toDF("term", "id"), relations.toDF("p", "r")
    out = triples.join(e.toDF("s", "h"), "s").join(e.toDF("o", "t"), "o").join(r, "p")
    return out.select("h", "r", "t")


def add_inverses(edges: DataFrame) -> DataFrame:
    """Each edge (h, r, t) and its inverse with relation ``r__inverse``."""
    r = F.col("r").cast("string")
    return edges.select("h", r.alias("r"), "t").unionByName(edges.select(F.col("t").alias("h"), F.concat(r, F.lit("__inverse")).alias("r"), F.col("h").alias("t")))


def uniform_negatives(edges: DataFrame, n_entities: int, seed: int = 0, side: str | None = None) -> DataFrame:
    """One corrupted copy of each edge: head or tail (by the parity of a hash, or ``side``) becomes a pseudorandom entity."""
    new = md5_number("h", "r", "t", F.lit(f"e{seed}")) % n_entities
    head = F.lit(side == "head") if side else md5_number("h", "r", "t", F.lit(f"s{seed}")) % 2 == 0
    return edges.select(F.when(head, new).otherwise(F.col("h")).alias("h"), "r", F.when(head, F.col("t")).otherwise(new).alias("t"))


def relation_negatives(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Tails replaced by a tail of the same relation, which a hash picks from the relation's distinct tails."""
    pool = edges.select("r", "t").distinct()
    sizes = pool.groupBy("r").agg(F.count("*").alias("n"))
    ranked = pool.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("t")) - 1).select("r", "k", F.col("t").alias("new"))
    want = edges.join(F.broadcast(sizes), "r").withColumn("k", md5_number("h", "r", "t", F.lit(f"r{seed}")) % F.col("n"))
    return want.join(ranked, ["r", "k"]).select("h", "r", F.col("new").alias("t"), F.col("t").alias("true_t"))


def filtered_negatives(edges: DataFrame, n_entities: int, each: int, seed: int = 0, true: DataFrame | None = None, first: int = 0, short: int = 64) -> DataFrame:
    """(h, r, t, neg): ``each`` different false tails of every distinct edge, of the entities ``first`` to ``first + n_entities - 1``; all of them where there are fewer.

    A false tail is drawn by its rank among the entities that are no tail of the head and relation in ``true`` (``edges`` unless given): ranks are split into
    ``each`` equal stretches and a hash picks one of each, so no draw fails and none repeats. The entity of rank j is j plus the number of true tails before it. Lists of at most ``short`` true tails stand
    with their head; longer ones in blocks of about a root of ``n_entities`` ids, with a directory of what stands before each block, so that a draw meets one block. Edges with a null are left out.
    """
    width = max(math.isqrt(max(n_entities, 1)), 1)
    some = cut(edges.select("h", "r", "t").na.drop().distinct(), "edges")
    tails = (some if true is None else true).select("h", "r", (F.col("t") - first).alias("x")).filter((F.col("x") >= 0) & (F.col("x") < n_entities)).distinct()
    blocks = tails.groupBy("h", "r", F.floor(F.col("x") / width).alias("block")).agg(F.sort_array(F.collect_list("x")).alias("held"))  # at most `width` ids
    of = Window.partitionBy("h", "r")  # at most n_entities / width blocks
    blocks = blocks.withColumns({
        "before": F.coalesce(F.sum(F.size("held")).over(of.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(F.size("held")).over(of),
    })
    blocks = cut(blocks, "tail-blocks")
    directory = blocks.groupBy("h", "r").agg(
        F.first("total").alias("total"), F.flatten(F.array_sort(F.collect_list(F.when(F.col("total") <= short, F.col("held"))))).alias("few"),
        F.sort_array(F.collect_list(F.when(F.col("total") > short, F.struct((F.col("block") * width - F.col("before")).alias("rank"), "block")))).alias("listed"),
    )
    heads = cut(some.groupBy("h", "r").agg(F.count("*").alias("edges")).join(directory, ["h", "r"], "left"), "heads")
    rows = attach(some, heads, ["h", "r"], "edges", some.count(), 64).withColumn("free", n_entities - F.coalesce("total", F.lit(0)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    rows = rows.withColumns({"low": F.expr(f"i * free div {each}"), "high": F.expr(f"(i + 1) * free div {each}")}).filter("high > low")
    rows = rows.withColumn("j", F.col("low") + md5_number("h", "r", "t", "i", F.lit(f"f{seed}")) % (F.col("high") - F.col("low")))
    up_to = lambda held, before: F.size(F.filter(held, lambda x, i: x - before - i <= F.col("j")))
    near = rows.filter(F.coalesce("total", F.lit(0)) <= short).select("h", "r", "t", (F.col("j") + F.coalesce(F.when(F.size("few") > 0, up_to("few", F.lit(0))), F.lit(0)) + first).alias("neg"))
    far = rows.filter(F.col("total") > short).select("h", "r", "t", "j", F.get(F.filter("listed", lambda x: x["rank"] <= F.col("j")), F.size(F.filter("listed", lambda x: x["rank"] <= F.col("j"))) - 1)["block"].alias("block"))
    far = far.join(blocks.select("h", "r", "block", "held", "before"), ["h", "r", "block"], "left")
    far = far.select("h", "r", "t", (F.col("j") + F.coalesce(F.col("before") + up_to("held", F.col("before")), F.lit(0)) + first).alias("neg"))
    return near.unionByName(far)


def family_split(edges: DataFrame, head_family: Column, tail_family: Column, share: float, seed: int = 0) -> DataFrame:
    """``is_test``: whether the family of either end is one of the test families."""
    test = lambda f: md5_number(f, F.lit(f"fam{seed}")) < int(share * (1 << 32))
    return edges.withColumn("is_test", test(head_family) | test(tail_family))


def dropout(edges: DataFrame, rate: float, epoch: int) -> DataFrame:
    return edges.filter(md5_number("h", "r", "t", F.lit(f"d{epoch}")) >= int(rate * (1 << 32)))


def align(nodes: DataFrame, vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Each node with its vector, or zeros, and whether it had one."""
    return nodes.join(vectors, key, "left").withColumn("matched", F.col(vector).isNotNull()).withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), dims).cast("array<float>")))


def export(vectors: DataFrame, wanted: DataFrame, key: str, vector: str) -> DataFrame:
    """``wanted`` with the vectors of its keys; those without one are left out."""
    return wanted.join(vectors.select(key, vector), key)


def anchor_targets(rows: DataFrame, key: str, columns: list[str], least: int = 100) -> DataFrame:
    """(key, property, z): population z-scores of the columns with enough values and some spread."""
    long = rows.unpivot([key], columns, "property", "value").filter("value is not null")
    stats = long.groupBy("property").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("s") >= 1e-8))
    return long.join(F.broadcast(stats), "property").select(key, "property", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


def rank_evaluation(scores: DataFrame, by: list[str]) -> DataFrame:
    """One row: mean reciprocal rank and hits of positives against their negatives (rank = 1 + negatives that score higher).

    Negatives meet their positive's score and are counted; no list of them is made.
    """
    best = scores.filter(F.col("y") == 1).groupBy(*by).agg(F.max("score").alias("pos"))
    over = scores.filter(F.col("y") == 0).join(best, by).groupBy(*by).agg(F.count_if(F.col("score") > F.col("pos")).alias("over"))
    ranks = best.join(over, by, "left").select((1 + F.coalesce("over", F.lit(0))).alias("rank"))
    return ranks.agg(F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("int")).alias(f"hits_{k}") for k in (1, 3, 10)], F.count("*").alias("n"))


def component_vectors(links: DataFrame, vectors: DataFrame, key: str, component: str, vector: str, dims: int, least: int) -> DataFrame:
    """(component, vector, n): the mean vector of what holds a component, for those with at least ``least`` vectors."""
    return V.mean_by(links.join(vectors, key), component, vector, dims).filter(F.col("n") >= least)


def knn_purity(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row: the share of neighbours (query, key) of the query's own label."""
    a, b = labels.select(F.col(key).alias("query"), F.col(label).alias("own")), labels.select(key, F.col(label).alias("other"))
    return neighbours.join(a, "query").join(b, key).agg(F.avg((F.col("own") == F.col("other")).cast("int")).alias("purity"), F.count("*").alias("n"))


def silhouette(points: DataFrame, key: str, label: str, vector: str, most: int = 4096) -> DataFrame:
    """One row: the mean Euclidean silhouette of all points with a whole vector, 0 for one alone in its label; keys are numbers, blocks of points hold about ``most``."""
    far = distances_by_class(points, key, label, vector, most).select("i", "other", (F.col("far") / F.col("n")).alias("d"))
    own = whole(points, key, vector).select(F.col("key").alias("i")).join(points.select(F.col(key).alias("i"), F.col(label).cast("string").alias("own")), "i")
    each = own.join(far, "i", "left").groupBy("i").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("b"))
    return each.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"), F.count("*").alias("n"))


def structure_quality(points: DataFrame, key: str, labels: list[str], vector: str, k: int) -> DataFrame:
    """(label_column, purity, silhouette, n): of each label column, over the points that it labels; the driver sees one row for each."""
    spark, out = points.sparkSession, []
    points = cut(points, "labelled-points")
    for name in labels:
        rows = points.filter(F.col(name).isNotNull())
        purity = knn_purity(nearest_by_cosine(rows, rows, key, vector, k), rows, key, name).first()["purity"]
        found = silhouette(rows, key, name, vector).first()
        out.append((name, purity, found["silhouette"], found["n"]))
    return spark.createDataFrame(out, "label_column string, purity double, silhouette double, n long")


def propagate(edges: DataFrame, vectors: DataFrame, relations: DataFrame, dims: int, composition: str = "sub") -> DataFrame:
    """(id, v): for each node the mean of the composed messages comp(source, relation) of its edges in both directions, and of its own vector.

    ``vectors`` (id, v), ``relations`` (r, w).
    """
    both = edges.select("h", "r", "t").unionByName(edges.select(F.col("t").alias("h"), "r", F.col("h").alias("t")))
    combine = {"sub": V.subtract, "mult": V.multiply, "corr": V.circular_correlation}[composition]
    messages = both.join(vectors.toDF("h", "v"), "h").join(F.broadcast(relations.toDF("r", "w")), "r").select(F.col("t").alias("id"), combine(F.col("v"), F.col("w")).alias("v"))
    own = vectors.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    return V.mean_by(messages.unionByName(own), "id", "v", dims).select("id", "v")


def random_walks(edges: DataFrame, per_node: int, length: int, seed: int = 0, repeats: bool = False) -> DataFrame:
    """(start, walk, path): first-order walks over an undirected graph (a, b); each step is one join on the current node and a neighbour's rank.

    A hash picks the next of a node's neighbours by its rank, so hubs' lists are never gathered; degrees travel with the neighbours. With ``repeats``, a link that stands twice
    is drawn twice as often.
    """
    from orefield.operators.walks import ranked_neighbours

    ranked, degree = ranked_neighbours(edges, repeats=repeats)
    walks = degree.select(F.col("a").alias("start"), "deg", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk")).withColumns({"at": F.col("start"), "path": F.array("start")})
    for step in range(1, length):
        walks = walks.withColumn("k", md5_number("start", "walk", F.lit(f"{seed}.{step}")) % F.col("deg"))
        walks = walks.join(ranked, ["at", "k"]).select("start", "walk", F.col("b").alias("at"), F.col("deg_b").alias("deg"), F.concat("path", F.array("b")).alias("path"))
    return walks.select("start", "walk", "path")


def transe_epoch(edges: DataFrame, vectors: DataFrame, relations: DataFrame, dims: int, n_entities: int, epoch: int, rate: float = 0.05, margin: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Entity and relation vectors after one epoch of margin ranking on L1 distances: joins, subgradients, one sum per vector, unit length.

    ``edges`` (h, r, t), ``vectors`` (id, v), ``relations`` (r, w).
    """
    e = vectors.toDF("id", "v")
    neg = edges.withColumns({"n": md5_number("h", "r", "t", F.lit(f"t{epoch}")) % n_entities})
    rows = neg.join(e.toDF("h", "vh"), "h").join(e.toDF("t", "vt"), "t").join(e.toDF("n", "vn"), "n").join(F.broadcast(relations.toDF("r", "w")), "r")
    lost = V.l1_distance(V.add(F.col("vh"), F.col("w")), F.col("vt")) + margin - V.l1_distance(V.add(F.col("vh"), F.col("w")), F.col("vn"))
    rows = rows.filter(lost > 0)
    sign = lambda target: F.zip_with(V.add(F.col("vh"), F.col("w")), F.col(target), lambda x, y: F.signum(x - y))
    rows = rows.select("h", "r", "t", "n", sign("vt").alias("gp"), sign("vn").alias("gn"))
    neg_of = lambda c: F.transform(c, lambda x: -x)
    parts = [rows.select(F.col("h").alias("id"), V.subtract(F.col("gp"), F.col("gn")).alias("g")), rows.select(F.col("t").alias("id"), neg_of("gp").alias("g")), rows.select(F.col("n").alias("id"), F.col("gn").alias("g"))]
    grads = V.mean_by(reduce(DataFrame.unionByName, parts), "id", "g", dims, "sum")
    moved = vectors.join(grads.select("id", "g"), "id", "left")
    step = F.when(F.col("g").isNull(), F.transform("v", lambda x: x.cast("double"))).otherwise(F.zip_with("v", "g", lambda x, g: x.cast("double") - rate * g))
    new = moved.select("id", step.alias("v")).select("id", V.l2_normalize(F.col("v")).alias("v"))
    rel = V.mean_by(rows.select("r", V.subtract(F.col("gp"), F.col("gn")).alias("g")), "r", "g", dims)
    rels = relations.toDF("r", "w").join(rel.select("r", "g"), "r", "left").select("r", F.when(F.col("g").isNull(), F.transform("w", lambda x: x.cast("double"))).otherwise(F.zip_with("w", "g", lambda x, g: x.cast("double") - rate * g)).alias("w"))
    return new, rels
