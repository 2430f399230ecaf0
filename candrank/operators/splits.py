"""Splits, folds and samples of groups; every random order is an MD5 of key and seed."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators.order import draw, group_places, seeded_places, values_at


def split_by_predicate(groups: DataFrame, key: list[str], held: Column, val_share: float = 1.0, seed: int = 0) -> DataFrame:
    """role: train, val or test. The held groups are val up to val_share of them in seeded order, then test."""
    placed = seeded_places(groups.withColumn("held", held), ["held"], key, seed)
    cut = F.floor(F.col("part_rows") * val_share + 0.5)
    return placed.withColumn("role", F.when(~F.col("held"), "train").when(F.col("place") < cut, "val").otherwise("test")).drop("held", "place", "part_rows")


def check_split(split: DataFrame, key: list[str], unseal: bool = False) -> DataFrame:
    """n_train, n_val, n_test, overlapping. Test is counted only, and returned by nothing unless unsealed."""
    per_key = split.groupBy(*key).agg(F.count_distinct("role").alias("roles"))
    counts = split.agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "val", "test")])
    return counts.crossJoin(per_key.agg(F.count_if(F.col("roles") > 1).alias("overlapping"))).withColumn("sealed", F.lit(not unseal))


def role(split: DataFrame, name: str, unseal: bool = False) -> DataFrame:
    if name == "test" and not unseal:
        raise PermissionError("the test role is sealed")
    out = split.where(F.col("role") == name)
    if out.isEmpty():
        raise ValueError(f"no group has the role {name}")
    return out


def stratified_kfold(groups: DataFrame, key: list[str], stratum: str, k: int, seed: int = 0) -> DataFrame:
    """fold: each stratum in seeded order, dealt round."""
    return seeded_places(groups, [stratum], key, seed).withColumn("fold", F.col("place") % k).drop("place", "part_rows")


def deal(classes: Iterable[tuple[int, int, int]], k: int, start: tuple[int, int] = (0, 0)) -> list[tuple[int, int, int, int, list[int]]]:
    """Each block of classes (size, out, count) to the fold with the fewest groups, then out-of-band groups, then the first.

    start is what the first fold holds already, groups and those out of band. Gives (size, out, begin, end, folds):
    the class's blocks from begin to end go to the folds in turn. Folds
    that a round reaches are dealt one block each, in the same order round after round, until another fold is
    as low: so many rounds are one step, and the work grows with the different sizes, not with the blocks.
    """
    load, out_of, runs = [0] * k, [0] * k, []
    load[0], out_of[0] = start
    for size, out, count in classes:
        at = 0
        while at < count:
            order = sorted(range(k), key=lambda i: (load[i], out_of[i], i))
            low = load[order[0]]
            turn = [i for i in order if load[i] < low + max(size, 1)]
            others = [load[i] for i in order if load[i] >= low + max(size, 1)]
            rounds = max(1, -(-(min(others) - low) // size) - 1) if others and size else -(-count // len(turn))
            rounds = min(rounds, (count - at) // len(turn))
            if not rounds:  # the last of the class
                turn, rounds = turn[: count - at], 1
            end = at + rounds * len(turn)
            runs.append((size, out, at, end, turn))
            for i in turn:
                load[i] += rounds * size
                out_of[i] += rounds * out
            at = end
    return runs


def grouped_folds(groups: DataFrame, block: list[str], k: int, in_band: Column, pin: Column | None = None) -> DataFrame:
    """fold of each block of groups: largest first, each to the fold with the fewest groups, then out-of-band groups, then the first.

    Blocks of one size and out-of-band count are in seeded order. Blocks with a group for which pin holds are
    fold 0's from the start, and the others are dealt as that leaves the folds; none such is an error. What the
    driver deals is the table of different sizes, at whatever number of blocks; n^2 / 2 groups at least have n
    different sizes.
    """
    sizes = groups.groupBy(*block).agg(F.count("*").alias("n"), F.count_if(~in_band).alias("out"), F.max(F.coalesce(pin, F.lit(False)) if pin is not None else F.lit(False)).alias("__pin"))
    start, fixed = (0, 0), None
    if pin is not None:
        fixed = sizes.where("__pin")
        held = fixed.agg(F.sum("n").alias("n"), F.sum("out").alias("out")).first()  # one row
        if held.n is None:
            raise ValueError("no block is pinned")
        start = (held.n, held.out)
    free = sizes.where("NOT __pin").drop("__pin")
    classes = free.groupBy("n", "out").agg(F.count("*").alias("c")).orderBy(F.desc("n"), "out")
    runs = deal(((r.n, r.out, r.c) for r in classes.toLocalIterator()), k, start)
    dealt = groups.sparkSession.createDataFrame(runs, "__n long, __out long, __begin long, __end long, __turn array<int>")
    placed = seeded_places(free, ["n", "out"], block)
    on = (F.col("n") == F.col("__n")) & (F.col("out") == F.col("__out")) & (F.col("place") >= F.col("__begin")) & (F.col("place") < F.col("__end"))
    fold = F.get("__turn", ((F.col("place") - F.col("__begin")) % F.size("__turn")).cast("int"))
    out = placed.join(dealt, on).select(*block, "n", "out", fold.alias("fold"))
    return out if fixed is None else out.unionByName(fixed.select(*block, "n", "out", F.lit(0).alias("fold")))


def fold_checks(folds: DataFrame, key: list[str], block: list[str], in_band: Column, attribute: str | None = None, regime: str | None = None, value: str | None = None) -> DataFrame:
    """For each fold: groups, groups held out more than once, blocks that are in training too, share out of band, and the fold's share of all out of band.

    With attribute: groups whose attribute some group in training has (attribute_twins), and the largest share
    of one attribute in the fold (top_share). With regime: the least share that a regime has in the fold's
    training, of those that occur there (minority). With value: least, quartiles (the values at places n // 4
    and 3 n // 4), median and largest of its log2 in the fold. Values in a fold get their places cut by
    quantiles, so that a fold is many tasks.
    """
    times = folds.groupBy(*key).agg(F.count("*").alias("times"))
    spread = folds.groupBy(*block).agg(F.count_distinct("fold").alias("folds"))
    rows = folds.join(times, key).join(spread, block)
    total = folds.agg(F.count_if(~in_band).alias("__out"))
    out = rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("folds") > 1).alias("with_twins"), F.avg((~in_band).cast("int")).alias("out_share"), F.count_if(~in_band).alias("__mine"))
    out = out.crossJoin(F.broadcast(total)).withColumn("out_of_all", F.coalesce(F.col("__mine") / F.nullif("__out", F.lit(0)), F.lit(0.0))).drop("__mine", "__out")
    if attribute:
        held = folds.groupBy(attribute, "fold").agg(F.count("*").alias("c"))
        in_folds = held.join(held.groupBy(attribute).agg(F.count("*").alias("folds")), attribute)
        twins = in_folds.groupBy("fold").agg(F.coalesce(F.sum(F.when(F.col("folds") > 1, F.col("c"))), F.lit(0)).alias("attribute_twins"), (F.max("c") / F.sum("c")).alias("top_share"))
        out = out.join(twins, "fold")
    if regime:
        counts = folds.groupBy("fold", regime).agg(F.count("*").alias("c"))
        every = counts.groupBy(regime).agg(F.sum("c").alias("all"))
        other = folds.select("fold").distinct().crossJoin(F.broadcast(every)).join(counts, ["fold", regime], "left").select("fold", (F.col("all") - F.coalesce("c", F.lit(0))).alias("c"))  # folds and regimes are few
        out = out.join(other.groupBy("fold").agg((F.min(F.when(F.col("c") > 0, F.col("c"))) / F.sum("c")).alias("minority")), "fold")
    if value:
        placed = group_places(folds.select("fold", *key, F.log2(value).alias("__v")), ["fold"], "__v", key)
        at = lambda p: F.max(F.when(F.col("place") == p, F.col("__v")))
        n = F.col("part_rows")
        middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
        out = out.join(placed.groupBy("fold").agg(F.min("__v").alias("lo"), at(F.floor(n / 4)).alias("q1"), middle.alias("mid"), at(F.floor(3 * n / 4)).alias("q3"), F.max("__v").alias("hi")), "fold")
    return out


def balance(split: DataFrame, regime: str, least: float = 0.25) -> DataFrame:
    """Share of each regime in each role, and whether it is below the least."""
    counts = split.groupBy("role", regime).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("role"))
    return counts.withColumn("share", share).withColumn("minority", F.col("share") < least)


def _shares(sizes: DataFrame, stratum: str, n: int, proportional: bool) -> DataFrame:
    """stratum, wanted from sizes(stratum, size): even shares, the remainder to the largest; or one each and the others in proportion, the remainder to the first by name."""
    k = F.count("*").over(Window.partitionBy())  # as many rows as strata
    if proportional:
        left = F.greatest(F.lit(n) - k, F.lit(0))
        part = F.floor(F.col("size") / F.sum("size").over(Window.partitionBy()) * left)
        sizes = sizes.select(stratum, "size", k.alias("k"), left.alias("left"), part.alias("part")).withColumn("rest", F.col("left") - F.sum("part").over(Window.partitionBy()))
        turn = F.row_number().over(Window.orderBy(stratum)) - 1
        extra = F.floor(F.col("rest") / F.col("k")) + F.when(turn < F.col("rest") % F.col("k"), 1).otherwise(0)
        share = F.when(F.col("k") > n, F.raise_error(F.lit(f"more strata than {n}")).cast("long")).otherwise(1 + F.col("part") + extra)
    else:
        share = F.floor(F.lit(n) / k) + F.when(F.row_number().over(Window.orderBy(F.desc("size"), stratum)) <= n % k, 1).otherwise(0)
    return sizes.withColumn("wanted", F.least("size", share)).select(stratum, "wanted")


def sample_stratified(groups: DataFrame, key: list[str], stratum: str, n: int, seed: int = 0, proportional: bool = False) -> DataFrame:
    """n groups spread over the strata, in seeded order inside: evenly, the remainder from the largest ones, or one of each and the others in proportion to the strata.

    A stratum that is smaller than its share gives all it has; proportional shares of more strata than groups are an error.
    """
    sizes = groups.groupBy(stratum).agg(F.count("*").alias("size"))
    wanted = _shares(sizes, stratum, n, proportional)  # as many rows as strata
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), *key))
    return groups.withColumn("place", place).join(wanted, stratum).where("place <= wanted").drop("place", "wanted")


def sample_boundary(groups: DataFrame, key: str, ratio: str, n: int) -> DataFrame:
    """The n groups whose ratio is nearest to 1, ties to the lower key."""
    return groups.where(F.col(ratio).isNotNull()).orderBy(F.abs(F.col(ratio) - 1), key).limit(n)


def sample_mixed(groups: DataFrame, key: str, ratio: str, value: str, n: int) -> DataFrame:
    """n groups: half of them (rounded down) the nearest to the boundary, then those of the spread sample that are not among them, in its order."""
    near = sample_boundary(groups, key, ratio, n // 2).select(key, value).collect()  # n / 2 rows
    taken = {r[key] for r in near}
    rest = [r for r in sample_spread(groups, key, value, n).collect() if r[key] not in taken][: n - len(near)]  # n rows
    kinds = dict(groups.dtypes)
    rows = [(r[key], None if r[value] is None else float(r[value]), arm) for arm, part in (("boundary", near), ("spread", rest)) for r in part]
    return groups.sparkSession.createDataFrame(rows, f"{key} {kinds[key]}, {value} double, arm string")


def sample_spread(groups: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """n groups whose values are nearest to the centres of n equal shares, none twice, ties to the lower value and key.

    The targets are exact quantiles. A target can lose n - 1 groups to those before it, so its n nearest are
    enough: they lie between the values n places below and above it, and n for each target reach the driver.
    """
    total = groups.where(F.col(value).isNotNull()).count()
    n = min(n, total)
    ranks, targets = {0}, []
    for i in range(n):
        x = (i + 0.5) / n * (total - 1)
        targets.append((i, x, max(0, math.floor(x) - n), min(total - 1, math.ceil(x) + n)))
        ranks |= {math.floor(x), math.ceil(x), *targets[-1][2:]}
    found = values_at(groups, {value: sorted(ranks)})[value] if n else {}
    rows = []
    for i, x, lo, hi in targets:
        share = x - math.floor(x)
        a, b = found[math.floor(x)], found[math.ceil(x)]
        rows.append((i, a if share == 0 else (1 - share) * a + share * b, found[lo], found[hi]))
    spark = groups.sparkSession
    wanted = spark.createDataFrame(rows, "i int, target double, lo double, hi double")
    v = F.col(value).cast("double")
    near = groups.select(F.col(key).alias("k"), v.alias("v")).join(F.broadcast(wanted), F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("d", F.abs(F.col("v") - F.col("target")))
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("d", "v", "k"))).where(F.col("rn") <= n)
    taken, picked = set(), []
    for r in sorted(near.collect(), key=lambda r: (r.i, r.rn)):  # n^2 rows at most
        if len(picked) == r.i and r.k not in taken:
            taken.add(r.k)
            picked.append((r.k, r.v))
    return spark.createDataFrame(picked, f"{key} {dict(groups.dtypes)[key]}, {value} double")


def spread_groups(groups: DataFrame, key: list[str], structure: str, n: int) -> DataFrame:
    """One of each structure at least, then further ones round by round up to n."""
    inside = groups.withColumn("turn", F.row_number().over(Window.partitionBy(structure).orderBy(*key))).where(F.col("turn") <= max(1, n))
    return inside.where("turn = 1").unionByName(inside.orderBy("turn", structure, *key).limit(n).where("turn > 1"))


def halve(groups: DataFrame, key: list[str], seed: object, stratum: str | None = None) -> DataFrame:
    """half: a or b, in seeded order, stratum by stratum if given; an odd one goes to a where the seeded coin of the stratum is below a half."""
    placed = seeded_places(groups, [stratum] if stratum else [], key, seed)
    coin = C.uniform("coin", *([F.col(stratum)] if stratum else []), seed) < 0.5
    n = F.col("part_rows")
    cut = F.floor(n / 2) + F.when((n % 2 == 1) & coin, 1).otherwise(0)
    return placed.withColumn("half", F.when(F.col("place") < cut, "a").otherwise("b")).drop("place", "part_rows")


def honest_selection(ev_rules: DataFrame, key: list[str], halvings: int) -> DataFrame:
    """For each halving: the rule that is best on half a, its regret on half b, and the best there.

    ev_rules has rule, the key and regret; a group's half is the parity of its place in the halving's order.
    """
    groups = ev_rules.select(*key).distinct().crossJoin(ev_rules.sparkSession.range(halvings).toDF("halving"))
    half = seeded_places(groups, ["halving"], key, F.col("halving")).withColumn("half", F.when(F.col("place") % 2 == 0, "a").otherwise("b"))
    geo = ev_rules.join(half, key).groupBy("halving", "rule").agg(*[C.geomean(F.when(F.col("half") == h, F.col("regret"))).alias(h) for h in "ab"])
    return geo.groupBy("halving").agg(F.min_by("rule", F.struct("a", "rule")).alias("rule"), F.min("a").alias("chosen_on"), F.min_by("b", F.struct("a", "rule")).alias("read_on"), F.min("b").alias("oracle")).withColumn("loss", F.col("read_on") - F.col("oracle"))


def selection_overfit(ev_rules: DataFrame) -> DataFrame:
    """The training winner's held-out rank and regret, the best held-out regret and the gap. ev_rules has rule, role, regret."""
    geo = ev_rules.groupBy("rule").agg(*[C.geomean(F.when(F.col("role") == r, F.col("regret"))).alias(r) for r in ("train", "val")])
    ranked = geo.withColumn("val_rank", F.rank().over(Window.orderBy("val")))  # one row for each rule
    return ranked.agg(F.min_by("rule", F.struct("train", "rule")).alias("rule"), F.min_by("val_rank", F.struct("train", "rule")).alias("val_rank"), F.min_by("val", F.struct("train", "rule")).alias("val"), F.min("val").alias("best_val")).withColumn("gap", F.col("val") - F.col("best_val"))
