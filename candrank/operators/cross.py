"""Joins of two tables, of recommendations, and of candidate pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators.order import group_places
from candrank.table import Measurements


def common_groups(a: Measurements, b: Measurements) -> DataFrame:
    return a.rows.select(*a.groups).distinct().join(b.rows.select(*b.groups), list(a.groups), "left_semi")


def common_axes(a: Measurements, b: Measurements, axes: tuple[str, ...]) -> DataFrame:
    """Coordinates that a group has in both tables; a null coordinate equals a null one."""
    key = [*a.groups, *axes]
    x, y = a.rows.select(*key).distinct().alias("x"), b.rows.select(*key).distinct().alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key])
    return x.join(y, same, "left_semi")


def cross_report(a: Measurements, b: Measurements) -> DataFrame:
    """Groups and candidates that both, only a and only b have."""
    key = [*a.groups, *a.ids]
    x, y = a.rows.select(*key).distinct().withColumn("a", F.lit(True)), b.rows.select(*key).distinct().withColumn("b", F.lit(True))
    both = x.join(y, key, "full")
    per_group = both.groupBy(*a.groups).agg(F.count_if(F.col("a") & F.col("b")).alias("c"), F.count_if(F.col("a") & F.col("b").isNull()).alias("x"), F.count_if(F.col("a").isNull()).alias("y"))
    ga, gb = F.col("c") + F.col("x") > 0, F.col("c") + F.col("y") > 0
    return per_group.agg(
        F.sum("c").alias("both"), F.sum("x").alias("only_a"), F.sum("y").alias("only_b"), F.count_if(ga & gb).alias("groups_both"), F.count_if(ga & ~gb).alias("groups_a"), F.count_if(gb & ~ga).alias("groups_b")
    )


def bound_flips(groups: DataFrame, value: str, knee_a: float, knee_b: float) -> DataFrame:
    """Groups whose regime differs under the two knees."""
    regime = lambda k: F.when(F.col(value) / k < 1, "mem").otherwise("comp")
    return groups.withColumns({"regime_a": regime(knee_a), "regime_b": regime(knee_b)}).where("regime_a <> regime_b")


def transfer_order(train: Measurements, target: Measurements, axes: tuple[str, ...], unseen: float = 1e9) -> Measurements:
    """target with transfer: the geometric mean of its coordinates' relative cost in train; unseen ones come last."""
    known = train.with_best().groupBy(*axes).agg(C.geomean(F.col(train.cost) / F.col("best")).alias("transfer"))
    rows = target.rows.join(known, list(axes), "left").withColumn("transfer", F.round(F.coalesce("transfer", F.lit(unseen)), 9))
    return target.of(rows)


def match_exact(wanted: DataFrame, mt: Measurements, axes: tuple[str, ...]) -> DataFrame:
    """wanted with the best candidate of its group at the same coordinates, and found."""
    at = mt.rows.groupBy(*mt.groups, *axes).agg(F.min(mt.cost).alias("matched"))
    return wanted.join(at, [*mt.groups, *axes], "left").withColumn("found", F.col("matched").isNotNull())


def log_distance(axes: tuple[str, ...], weights: tuple[float, ...], wanted: str = "w_") -> Column:
    """Weighted squared distance of log2(max(x, 1) + 1) between the axes and the wanted ones, rounded so that ties are ties."""
    scale = lambda c: F.log2(F.greatest(F.col(c), F.lit(1)) + 1)
    return F.round(sum((w * F.pow(scale(a) - scale(wanted + a), F.lit(2)) for a, w in zip(axes, weights)), F.lit(0.0)), 9)


def recommended(wishes: DataFrame, mt: Measurements, axes: tuple[str, ...], weights: tuple[float, ...], nearest: bool = True, name: str = "wish") -> Measurements:
    """mt with a score by which its candidates come in the order that wishes(groups, wish, axes) recommend.

    Each wish of a group is the candidate at its coordinates, the first by identity, or else the nearest one;
    without nearest it is passed over, as are wishes with null coordinates. A candidate that several wishes mean has
    the first one's place; all others follow by identity. The pick of a wish is an aggregate, and the order a
    score: no group is sorted before it is evaluated. The picks join as one list for each group, as long as its
    wishes, so that rows dealt by group are not dealt again by identity.
    """
    asked = wishes.dropna(subset=["wish", *axes]).select(*mt.groups, "wish", *[F.col(a).alias(f"w_{a}") for a in axes])
    pairs = mt.rows.select(*mt.groups, *dict.fromkeys([*mt.ids, *axes])).join(asked, list(mt.groups))
    exact = reduce(lambda p, q: p & q, [F.col(a) == F.col(f"w_{a}") for a in axes])
    pairs = pairs.withColumn("__apart", F.when(exact, F.lit(-1.0)).otherwise(log_distance(axes, weights)))
    if not nearest:
        pairs = pairs.where(exact)
    picks = pairs.groupBy(*mt.groups, "wish").agg(F.min_by(F.struct(*mt.ids), F.struct("__apart", *mt.ids)).alias("x"))
    listed = picks.groupBy(*mt.groups).agg(F.collect_list(F.struct(F.col("wish").cast("long").alias("wish"), "x")).alias("__picks"))
    own = F.array_min(F.transform(F.filter("__picks", lambda p: p["x"] == F.struct(*mt.ids)), lambda p: p["wish"]))
    rows = mt.rows.join(listed, list(mt.groups), "left").withColumn(name, F.coalesce(own, F.lit(1 << 40))).drop("__picks")
    return mt.of(rows)


def match_nearest(wanted: DataFrame, mt: Measurements, axes: tuple[str, ...], weights: tuple[float, ...]) -> DataFrame:
    """wanted with its group's nearest candidate by weighted squared distance of log2(max(x, 1) + 1).

    An equi-join on the group; the nearest is an aggregate, so that no group's pairs are sorted.
    """
    asked = wanted.select(*wanted.columns, *[F.col(a).alias(f"w_{a}") for a in axes]).drop(*axes)
    rows = mt.rows.join(asked, list(mt.groups)).withColumn("distance", log_distance(axes, weights))
    order = F.struct("distance", *mt.ids)
    return rows.groupBy(*mt.groups).agg(F.min("distance").alias("distance"), *[F.min_by(i, order).alias(i) for i in mt.ids], F.min_by(mt.cost, order).alias("picked"))


def pairs(mt: Measurements, top_n: int, anchor_best: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a group's top_n cheapest that the noise can tell apart, cheaper first, with weight (t_j - t_i) / best and the columns of keep."""
    t = mt.cost
    top = mt.ranked(t).where(F.col("rn") <= top_n).select(*mt.groups, "rn", t, *mt.ids, *keep)
    a = top.select(*mt.groups, *[F.col(c).alias(f"{c}_a") for c in ("rn", t, *mt.ids, *keep)])
    b = top.select(*mt.groups, *[F.col(c).alias(f"{c}_b") for c in ("rn", t, *mt.ids, *keep)])
    if anchor_best:
        a = a.where("rn_a = 1")
    out = a.join(b, list(mt.groups)).where("rn_a < rn_b").where(C.resolvable(F.col(f"{t}_a"), F.col(f"{t}_b"), mt.noise))
    return out.join(mt.bests(), list(mt.groups)).withColumn("weight", (F.col(f"{t}_b") - F.col(f"{t}_a")) / F.col("best"))


def contrast_pairs(mt: Measurements, n_pos: int, n_neg: int) -> DataFrame:
    """The n_pos cheapest of each group with n_neg others, spread evenly over the remaining places. A large group is cut for its places."""
    rows = group_places(mt.rows.select(*mt.groups, *mt.ids, mt.cost), list(mt.groups), mt.cost, list(mt.ids)).withColumn("rn", F.col("place") + 1)
    rest = F.col("part_rows") - n_pos
    step = F.when(F.lit(n_neg) > 1, (rest - 1) / (n_neg - 1)).otherwise(0.0)
    places = F.transform(F.sequence(F.lit(0), F.lit(n_neg - 1)), lambda i: n_pos + 1 + F.floor(i * step + 1e-9))
    negative = rows.where((rest > 0) & (F.col("rn") > n_pos) & F.array_contains(places, F.col("rn"))).select(*mt.groups, F.col("rn").alias("rn_b"), F.col(mt.cost).alias("t_b"))
    positive = rows.where(F.col("rn") <= n_pos).select(*mt.groups, F.col("rn").alias("rn_a"), F.col(mt.cost).alias("t_a"))
    return positive.join(negative, list(mt.groups))


def contact(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """For each split of a, how many of its held-out groups are in the training of each split of b."""
    held = a.where(F.col("role") != "train").select(F.col("split").alias("split_a"), *key)
    seen = b.where(F.col("role") == "train").select(F.col("split").alias("split_b"), *key)
    return held.join(seen, key).groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


def paired_log_diff(runs: DataFrame, arm: str, a: object, b: object, on: list[str], value: str = "regret") -> DataFrame:
    """ln(a / b) of each key that both arms have: mean, better and worse counts."""
    x = runs.where(F.col(arm) == a).groupBy(*on).agg(F.min(value).alias("x"))
    y = runs.where(F.col(arm) == b).groupBy(*on).agg(F.min(value).alias("y"))
    d = x.join(y, on).withColumn("d", F.log(F.col("x") / F.col("y")))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.count_if(F.col("d") < 0).alias("better"), F.count_if(F.col("d") > 0).alias("worse"))


def diff_tables(old: DataFrame, new: DataFrame, on: list[str], value: str) -> DataFrame:
    """old and new value of each key, and whether they differ; null equals null."""
    both = old.select(*on, F.col(value).alias("old")).join(new.select(*on, F.col(value).alias("new")), on, "full")
    return both.withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def jaccard_pairs(df: DataFrame, block: str, items: str) -> DataFrame:
    """Mean and median Jaccard similarity and exact share over all pairs of sets in a block.

    Equal sets are counted first. Different ones meet in the items that they share, so that a pair comes up as
    often as it has items in common; disjoint pairs are what is left of all pairs and only counted.
    """
    sets = df.groupBy(block, F.array_sort(items).alias("__x")).agg(F.count("*").alias("c"))
    sets = sets.select(block, F.md5(F.to_json("__x")).alias("__set"), F.size("__x").alias("size"), "c", "__x")
    posted = sets.select(block, "__set", "size", "c", F.explode("__x").alias("__item"))
    side = lambda s: posted.select(block, "__item", *[F.col(c).alias(f"{c}_{s}") for c in ("__set", "size", "c")])
    shared = side("a").join(side("b"), [block, "__item"]).where("__set_a < __set_b").groupBy(block, "__set_a", "__set_b", "size_a", "size_b", "c_a", "c_b").agg(F.count("*").alias("both"))
    meet = shared.select(block, (F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("j"), (F.col("c_a") * F.col("c_b")).alias("w"))
    equal = sets.where("c > 1").select(block, F.lit(1.0).alias("j"), F.expr("c * (c - 1) div 2").alias("w"))
    met = meet.unionByName(equal).groupBy(block, "j").agg(F.sum("w").alias("w"))
    every = sets.groupBy(block).agg(F.sum("c").alias("n")).select(block, F.expr("n * (n - 1) div 2").alias("n"))
    apart = every.join(met.groupBy(block).agg(F.sum("w").alias("met")), block, "left").select(block, F.lit(0.0).alias("j"), (F.col("n") - F.coalesce("met", F.lit(0))).alias("w")).where("w > 0")
    histogram = met.unionByName(apart)
    return histogram.groupBy(block).agg(F.sum("w").alias("n"), (F.sum(F.col("j") * F.col("w")) / F.sum("w")).alias("mean"), F.expr("percentile(j, 0.5, w)").alias("median"), (F.sum(F.when(F.col("j") == 1, F.col("w")).otherwise(0)) / F.sum("w")).alias("same"))


def jaccard_floor(sizes: DataFrame, pool: int, draws: int) -> DataFrame:
    """Mean Jaccard similarity of random sets of the given sizes (id, size_a, size_b) from a pool of items."""
    spark = sizes.sparkSession
    each = sizes.crossJoin(F.broadcast(spark.range(draws).toDF("draw")))

    def pick(side: str) -> Column:
        order = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(pool)), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(side), "id", "draw", i)).alias("h"), i.alias("i"))))
        return F.transform(F.slice(order, F.lit(1), F.col(f"size_{side}").cast("int")), lambda x: x["i"])

    drawn = each.select("id", "draw", pick("a").alias("a"), pick("b").alias("b"))
    j = F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size(F.array_union("a", "b")))
    return drawn.groupBy("id").agg(F.avg(j).alias("mean"), F.count("*").alias("draws"))


def merge_shards(shards: list[DataFrame], order: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), shards).orderBy(*order)
