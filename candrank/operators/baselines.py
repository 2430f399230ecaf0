"""Baselines: static choices, nearest recommendations, ridge and boosted trees."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.functions.features import level_code
from candrank.sources.shared import written
from candrank.table import Measurements

PENALTY = float(np.log(1000.0))


def relative(mt: Measurements, ids: tuple[str, ...]) -> DataFrame:
    """groups, ids, v: ln of each candidate's least relative cost in each group that has it."""
    best = mt.bests()
    return mt.rows.where(C.usable(F.col(mt.cost))).join(best, list(mt.groups)).groupBy(*mt.groups, *ids).agg(F.log(F.min(F.col(mt.cost) / F.col("best"))).alias("v"))


def static_topk(mt: Measurements, ids: tuple[str, ...], k: int, scratch=None) -> DataFrame:
    """k, ids, objective: greedy choice of k candidates that serve all groups, uncovered groups at the penalty.

    The state is one value for each group. In each round a candidate's gain is summed over the groups that it
    was measured in alone, so that nothing dense is built; the state is written each round where scratch (a
    folder) is given, which keeps the lineage short.
    """
    spark = mt.rows.sparkSession
    rel = relative(mt, ids)
    if scratch:
        rel.write.mode("overwrite").parquet(f"{scratch}/relative")
        rel = spark.read.parquet(f"{scratch}/relative")
    state = mt.rows.select(*mt.groups).distinct().withColumn("cur", F.lit(None).cast("double"))
    chosen = []
    for turn in range(1, k + 1):
        now = F.coalesce("cur", F.lit(PENALTY))
        base = state.agg(F.sum(now).alias("base"), F.count("*").alias("n"))
        gains = rel.join(state, list(mt.groups)).groupBy(*ids).agg(F.sum(F.least("v", "cur") - now).alias("gain"))
        objective = F.round((F.col("base") + F.col("gain")) / F.col("n"), 9)
        pick = gains.crossJoin(F.broadcast(base)).select(*ids, objective.alias("objective")).orderBy("objective", *ids).limit(1)
        row = pick.first()  # one row
        if row is None:
            break
        chosen.append((turn, *[row[i] for i in ids], row.objective))
        match = rel.where(" AND ".join(f"{i} = {row[i]!r}" for i in ids)).select(*mt.groups, F.col("v").alias("own"))
        state = state.join(match, list(mt.groups), "left").select(*mt.groups, F.least("cur", "own").alias("cur"))
        if scratch:
            state.write.mode("overwrite").parquet(f"{scratch}/state-{turn}")
            state = spark.read.parquet(f"{scratch}/state-{turn}")
    kinds = {f.name: f.dataType.simpleString() for f in mt.rows.schema.fields}
    return spark.createDataFrame(chosen, "k int, " + ", ".join(f"{i} {kinds[i]}" for i in ids) + ", objective double")


def static_first(mt: Measurements, ids: tuple[str, ...], by: tuple[str, ...] = (), rel: DataFrame | None = None) -> DataFrame:
    """by, ids, objective, geo, n, groups: the first static choice of each part of the groups (by: some of their columns), all parts in one pass.

    geo is the geometric mean over the n groups that the choice covers. rel is what relative gives, where it is known.
    """
    rel = relative(mt, ids) if rel is None else rel
    sizes = mt.rows.select(*mt.groups).distinct().groupBy(*by).agg(F.count("*").alias("groups"))
    sums = rel.groupBy(*by, *ids).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    sums = sums.join(F.broadcast(sizes), list(by)) if by else sums.crossJoin(F.broadcast(sizes))
    gains = sums.withColumn("objective", F.round((F.col("v") + PENALTY * (F.col("groups") - F.col("n"))) / F.col("groups"), 9))
    fields = F.struct(*ids, "objective", F.exp(F.col("v") / F.col("n")).alias("geo"), "n", "groups")
    return gains.groupBy(*by).agg(F.min_by(fields, F.struct("objective", *ids)).alias("x")).select(*by, "x.*")


def static_regret(mt: Measurements, ids: tuple[str, ...], chosen: DataFrame, stats: DataFrame | None = None, rel: DataFrame | None = None) -> DataFrame:
    """k, geo, n, cover: geometric mean of the best of the first k chosen candidates over the groups that they cover.

    With stats (a written table of the group statistics with small and hard), the same over the covered groups of
    each stratum, as geo_ and its name. rel is what relative gives, where that is written already.
    """
    rel = relative(mt, ids) if rel is None else rel
    upto = chosen.select(F.col("k").alias("turn"), *ids).join(chosen.select("k"), F.col("turn") <= F.col("k"))
    per = rel.join(F.broadcast(upto), list(ids)).groupBy("k", *mt.groups).agg(F.min("v").alias("v"))
    total = (mt.rows.select(*mt.groups).distinct() if stats is None else stats).agg(F.count("*").alias("total"))
    strata = []
    if stats is not None:
        per = per.join(stats.select(*mt.groups, "small", "hard"), list(mt.groups))
        strata = [F.exp(F.avg(F.when(c, F.col("v")))).alias(f"geo_{n}") for n, c in {"large": ~F.col("small"), "small": F.col("small"), "hard": F.col("hard"), "easy": ~F.col("hard")}.items()]
    return per.groupBy("k").agg(F.exp(F.avg("v")).alias("geo"), F.count("*").alias("n"), *strata).crossJoin(total).withColumn("cover", F.col("n") / F.col("total"))


def individual(mt: Measurements, ids: tuple[str, ...]) -> Measurements:
    """The candidates that every group has."""
    n = mt.rows.select(*mt.groups).distinct().agg(F.count("*").alias("total"))
    every = mt.rows.select(*mt.groups, *ids).distinct().groupBy(*ids).agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).where("c = total").select(*ids)
    return mt.of(mt.rows.join(every, list(ids), "left_semi"))


def static_procedures(procedures: list[tuple[str, Measurements]], ids: tuple[str, ...], k: int = 1) -> DataFrame:
    """procedure, geo, n, failed: each procedure's static choice; one without candidates is reported, not dropped."""
    out = None
    for name, mt in procedures:
        chosen = static_topk(mt, ids, k)
        one = static_regret(mt, ids, chosen).where(F.col("k") == k)
        row = mt.rows.sparkSession.range(1).select(F.lit(name).alias("procedure")).join(one.select("geo", "n"), how="left", on=F.lit(True)).withColumn("failed", F.col("geo").isNull())
        out = row if out is None else out.unionByName(row)
    return out


def random_groups(mt: Measurements, draws: int = 64) -> DataFrame:
    """groups, m: the median relative cost of draws with replacement; the draw's place is an MD5 share of the group's size."""
    place = lambda i: F.floor(C.uniform(*[F.col(g) for g in mt.groups], i) * F.col("n")).cast("int")
    wanted = mt.rows.groupBy(*mt.groups).agg(F.count("*").alias("n"), C.best_of(F.col(mt.cost)).alias("best"))
    wanted = wanted.select(*mt.groups, "best", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), place).alias("places"))
    placed = mt.rows.withColumn("tb", F.row_number().over(mt.per_group(*mt.ids)) - 1).select(*mt.groups, "tb", mt.cost).join(wanted, list(mt.groups))
    times = placed.withColumn("times", F.size(F.filter("places", lambda p: p == F.col("tb")))).where("times > 0").withColumn("rel", F.col(mt.cost) / F.col("best"))
    return times.groupBy(*mt.groups).agg(F.percentile(F.when(C.finite(F.col("rel")), F.col("rel")), F.lit(0.5), F.col("times")).alias("m"))


def random_column(mt: Measurements, draws: int = 64) -> DataFrame:
    """Geometric mean over groups of the median of random draws."""
    return random_groups(mt, draws).agg(C.geomean(F.col("m")).alias("regret"))


def _target(mt: Measurements) -> DataFrame:
    return mt.with_best().where(C.usable(F.col(mt.cost)))


def _coded(mt: Measurements, categories: dict[str, tuple[str, ...]] | None) -> tuple[DataFrame, dict[str, str]]:
    """Usable rows with label (ln of the relative cost) and a code column for each category; and the categories by code column."""
    rows = _target(mt).withColumn("label", F.log(F.col(mt.cost) / F.col("best")))
    coded = {f"__{c}": c for c in categories or {}}
    for code, c in coded.items():
        rows = rows.withColumn(code, level_code(c, categories[c]).cast("double"))
    return rows, coded


def _vectors(rows: DataFrame, features: list[str], coded: dict[str, str], categories: dict[str, tuple[str, ...]] | None) -> DataFrame:
    for code, c in coded.items():
        rows = rows.withMetadata(code, {"ml_attr": {"type": "nominal", "name": code, "vals": list(categories[c])}})
    return VectorAssembler(inputCols=[*features, *coded], outputCol="vector").transform(rows)


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the same features as one, with their mean label and number: squared error splits and means are those of the rows. Written, as a fit reads it several times."""
    return written(rows.groupBy(*by).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("__n")), "cells")


def _trees(trees: int, depth: int, prediction: str = "prediction") -> GBTRegressor:
    return GBTRegressor(featuresCol="vector", labelCol="label", weightCol="__n", predictionCol=prediction, maxIter=trees, maxDepth=depth, seed=1)


def gbdt(mt: Measurements, features: list[str], train: Column, trees: int = 20, depth: int = 4, categories: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Rows outside the training groups with a predicted ln of the relative cost, and the features' importances.

    categories are columns with fixed levels, which the trees split as sets; a value that is none of them is an error.
    Training rows of the same features are one weighted row, so that the rows are read once for all trees.
    """
    rows, coded = _coded(mt, categories)
    model = _trees(trees, depth).fit(_vectors(_cells(rows.where(train), [*features, *coded]), features, coded, categories))
    names = [*features, *coded.values()]
    return model.transform(_vectors(rows.where(~train), features, coded, categories)).drop("vector", *coded), dict(zip(names, model.featureImportances.toArray().tolist()))


def gbdt_folds(mt: Measurements, features: list[str], fold: Column, folds: int, trees: int = 20, depth: int = 4, categories: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All usable rows with the fold of their group (0 to folds - 1) and the prediction of the trees that were fitted on the other folds, as gbdt gives it for each.

    The rows are read twice at any number of folds: once for the weighted rows of all fits, once for the predictions.
    """
    rows, coded = _coded(mt, categories)
    rows = rows.withColumn("__fold", fold)
    cells = _vectors(_cells(rows, ["__fold", *features, *coded]), features, coded, categories)
    out = _vectors(rows, features, coded, categories)
    for i in range(folds):
        out = _trees(trees, depth, f"__p{i}").fit(cells.where(F.col("__fold") != i)).transform(out)
    own = [F.when(F.col("__fold") == i, F.col(f"__p{i}")) for i in range(folds)]
    return out.withColumn("prediction", F.coalesce(*own)).withColumnRenamed("__fold", "fold").drop("vector", *coded, *[f"__p{i}" for i in range(folds)])


def _level_sums(rows: DataFrame, codes: dict[str, int], sums: list[str]) -> tuple[dict, dict]:
    """From rows with a code column for each category: rows of each two levels of different categories, and rows and sums of each level.

    Rows are counted by all categories together first, so that what is paired is as many rows as there are
    different combinations; the two results are as long as the levels' pairs.
    """
    names = list(codes)
    every = rows.groupBy(*names).agg(F.count("*").alias("__n"), *[F.sum(c).alias(c) for c in sums])
    pairs = [[a, b] for i, a in enumerate(names) for b in names[i + 1 :]]
    found = every.groupingSets([[a] for a in names] + pairs, *names).agg(F.sum("__n").alias("__n"), *[F.sum(c).alias(c) for c in sums], *[F.grouping(c).alias(f"__g_{c}") for c in names])
    single, double = {}, {}
    for r in found.collect():  # levels and pairs of levels
        at = tuple((c, r[c]) for c in names if r[f"__g_{c}"] == 0)
        (single if len(at) == 1 else double)[at] = (r["__n"], *[r[c] for c in sums])
    return {k[0]: v for k, v in single.items()}, {k: v[0] for k, v in double.items()}


def ridge(mt: Measurements, features: list[str], train: Column, alpha: float = 1.0, categories: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows with a score from a centred ridge regression of best / cost on the training groups' rows: features standardised, categories one-hot.

    categories are columns with fixed levels; a value that is none of them is an error. The sums of products of
    the features are one aggregation, the levels' counts and sums another; the solve is of the features' and
    levels' number. The weights come in the order of the features, then the levels.
    """
    rows = _target(mt).withColumn("y", F.col("best") / F.col(mt.cost))
    coded = {f"__code_{c}": len(levels) for c, levels in (categories or {}).items()}
    for c, levels in (categories or {}).items():
        rows = rows.withColumn(f"__code_{c}", level_code(c, levels))
    rows = written(rows, "ridge")  # both sums and the scores read it
    names = [*features, "y"]
    sums = [F.count("*").alias("n")] + [F.avg(a).alias(f"m{i}") for i, a in enumerate(names)]
    sums += [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    fitted = rows.where(train)
    r = fitted.agg(*sums).first()  # one row
    d, n = len(features), r.n
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)])
    mean = np.array([r[f"m{i}"] for i in range(d + 1)])
    scale = np.sqrt(np.maximum(np.diag(cov)[:d], 1e-24))
    levels = [(c, i) for c, k in coded.items() for i in range(k)]
    x, right = np.zeros((d + len(levels), d + len(levels))), np.zeros(d + len(levels))
    x[:d, :d], right[:d] = cov[:d, :d] / np.outer(scale, scale) * n, cov[:d, d] / scale * n
    share = np.zeros(len(levels))
    if levels:
        single, double = _level_sums(fitted, coded, names)
        share = np.array([single.get(v, (0,))[0] for v in levels]) / n
        for i, v in enumerate(levels):
            count, *own = single.get(v, (0, *[0.0] * (d + 1)))
            own = np.array(own) - count * mean  # sums of what is centred
            x[d + i, :d] = x[:d, d + i] = own[:d] / scale
            right[d + i] = own[d]
            for j, w in enumerate(levels):
                both = count if v == w else double.get((v, w), double.get((w, v), 0))
                x[d + i, d + j] = both - n * share[i] * share[j]
    w = np.linalg.solve(x + alpha * np.eye(len(x)), right)
    score = sum(((F.col(a) - r[f"m{i}"]) * float(w[i] / scale[i]) for i, a in enumerate(features)), F.lit(0.0))
    at = d
    for c, k in coded.items():
        score += F.get(F.array(*[F.lit(float(v)) for v in w[at : at + k]]), F.col(c).cast("int"))
        at += k
    base = float(mean[d] - share @ w[d:])
    return rows.withColumn("score", -(score + base)).drop(*coded), np.concatenate([w[:d] / scale, w[d:]])
