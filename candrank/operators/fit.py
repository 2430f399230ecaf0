"""Linear scores: many weight vectors at once, fitting, contributions, caps."""

from __future__ import annotations

from collections.abc import Callable, Generator, Hashable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.table import Measurements

DIGITS = 9  # of a score, so that ties do not hang on the order of additions


def linear(features: list[str], weights: list[float] | list[Column]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [(F.lit(w) if isinstance(w, float) else w) * F.col(f) for f, w in zip(features, weights)]), DIGITS)


def weight_table(spark, vectors: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "weight_id int, w array<double>")


def regret_batch(mt: Measurements, features: list[str], vectors: DataFrame, on: Column | None = None) -> DataFrame:
    """weight_id, regret, infeasible: the first pick's geometric mean regret of each weight vector, in one pass.

    The vectors are few and broadcast; the pick is an aggregate (no sort), and partial in each task. Where on
    is given (a condition on the rows and the vectors), each vector is tried on its own rows.
    """
    t = mt.cost
    each = mt.rows.join(F.broadcast(vectors), on) if on is not None else mt.rows.crossJoin(F.broadcast(vectors))
    each = each.select("weight_id", "w", *mt.groups, *mt.ids, t, *features)
    score = linear(features, [F.col("w")[i] for i in range(len(features))])
    each = each.withColumn("score", score)
    bad = F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad")
    picks = each.groupBy("weight_id", *mt.groups).agg(F.min_by(t, F.struct("score", *mt.ids)).alias("t"), C.best_of(F.col(t)).alias("best"), bad)
    out = picks.groupBy("weight_id").agg(C.geomean(F.col("t") / F.col("best")).alias("regret"), (F.sum("bad") > 0).alias("infeasible"))
    return out.withColumn("regret", F.when(~F.col("infeasible"), F.col("regret")))


STEPS = (10.0, 3.0, 1.0, 0.5, 0.25, 0.1)  # shares of a weight (of 1 where it is smaller), large ones first
RESTART_SPREAD = 0.35
_MOVES = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def _bounded(w: list[float], bounds: list[tuple[float, float]] | None) -> list[float]:
    return [float(min(max(x, lo), hi)) for x, (lo, hi) in zip(w, bounds)] if bounds else [float(x) for x in w]


def _singles(w: list[float], step: float) -> list[list[float]]:
    return [[x + (d * step * max(abs(x), 1.0) if i == j else 0.0) for j, x in enumerate(w)] for i in range(len(w)) for d in (-1, 1)]


def _pairs(w: list[float], step: float) -> list[list[float]]:
    by = lambda x, d: x + d * step * max(abs(x), 1.0)
    return [[by(x, d) if j == i else by(x, e) if j == k else x for j, x in enumerate(w)] for i, k in combinations(range(len(w)), 2) for d, e in _MOVES]


def _descent(start: list[float], steps: tuple[float, ...], pairs: bool, bounds: list[tuple[float, float]] | None, budget: int) -> Generator[list[list[float]], list[float | None], list[tuple[str, float, list[float]]]]:
    """Asks for the regrets of batches of weight vectors (none where infeasible) and ends with (kind, regret, weights) of the start and each strict improvement.

    For each step size the best of all single-weight steps, as long as one is better; then, as the single ones
    are stuck, the best of all steps of two weights. budget is the number of weight vectors that may be tried.
    """
    best = _bounded(start, bounds)
    (first,) = yield [best]
    value = float("inf") if first is None else first
    log, used = [("start", value, best)], 1
    for step in steps:
        for kind, around in (("single", _singles), ("pair", _pairs)):
            if kind == "pair" and not (pairs and len(best) > 1):
                continue
            while tries := [_bounded(t, bounds) for t in around(best, step)][: max(0, budget - used)]:
                used += len(tries)
                got = yield tries
                i = min((j for j, r in enumerate(got) if r is not None), key=lambda j: (got[j], j), default=None)  # noqa: B023
                if i is None or got[i] >= value - 1e-12:
                    break
                best, value = tries[i], got[i]
                log.append((kind, value, best))
                if kind == "pair":
                    break
    return log


def _lockstep(ask: Callable[[dict[Hashable, list[list[float]]]], dict[Hashable, list[float | None]]], descents: dict[Hashable, Generator]) -> dict[Hashable, list[tuple[str, float, list[float]]]]:
    """The ends of several descents that step together: each round asks for what all of them want to know."""
    ends, wanted = {}, {k: next(d) for k, d in descents.items()}
    while wanted:
        got, wanted = ask(wanted), {}
        for k, regrets in got.items():
            try:
                wanted[k] = descents[k].send(regrets)
            except StopIteration as end:
                ends[k] = end.value
    return ends


PART, FOLD = "__part", "__fold"  # columns of rows that several fits share


@dataclass(frozen=True)
class Packed:
    """Rows of parts and folds in blocks, in the order of part, group and identity.

    A block is a batch of rows of one part; its columns are binary arrays, and it names its first and last
    group, the only ones that other blocks can hold rows of.
    """

    blocks: DataFrame
    groups: tuple[str, ...]


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it; nulls are alike."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _packing(groups: tuple[str, ...], features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [*_starts([batch.column(PART)]).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                rows = batch.slice(lo, hi - lo)
                code = np.zeros(hi - lo, "<i4")
                code[_starts([rows.column(g) for g in groups])[1:]] = 1
                number = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype("<f8")  # noqa: E731,B023
                arrays = [np.cumsum(code, dtype="<i4"), rows.column(FOLD).to_numpy(zero_copy_only=False).astype("<i4"), number("__t"), np.concatenate([number(f"__f{i}") for i in range(len(features))])]
                ends = [rows.column(g).slice(i, 1) for i in (0, hi - lo - 1) for g in groups]
                yield pa.RecordBatch.from_arrays([rows.column(PART).slice(0, 1), pa.array([at]), *[pa.array([a.tobytes()]) for a in arrays], *ends], [PART, "at", "code", "fold", "t", "f", *[f"{s}_{g}" for s in "az" for g in groups]])
                at += 1

    return run


def pack(mt: Measurements, features: list[str]) -> Packed:
    """The rows of mt, whose columns PART and FOLD say which trials see them, packed once for many passes; the caller drops them.

    Rows are dealt in ranges of part, group and identity, so that a large group is many tasks and blocks.
    """
    kinds = dict(mt.rows.dtypes)
    own = mt.rows.where(F.col(PART).isNotNull() & F.col(FOLD).isNotNull())
    own = own.select(PART, F.col(FOLD).cast("int").alias(FOLD), *mt.groups, *mt.ids, F.col(mt.cost).cast("double").alias("__t"), *[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    key = [PART, *mt.groups, *mt.ids]
    ends = "".join(f", `{s}_{g}` {kinds[g]}" for s in "az" for g in mt.groups)
    blocks = own.repartitionByRange(*key).sortWithinPartitions(*key).drop(*mt.ids).mapInArrow(_packing(mt.groups, features), f"{PART} {kinds[PART]}, at long, code binary, fold binary, t binary, f binary{ends}")
    return Packed(blocks.persist(), mt.groups)  # on disk where memory is short, computed again where an executor goes


def _rounded(x: np.ndarray) -> np.ndarray:
    """As F.round: half away from zero; larger numbers have no digit to lose."""
    return np.where(np.abs(x) < 1 << 23, np.copysign(np.floor(np.abs(x) * 10.0**DIGITS + 0.5) / 10.0**DIGITS, x), x)


def _tried(groups: tuple[str, ...], trials: list[tuple[int, Hashable, int, bool, list[float]]]):
    """Each trial's picks in a block: the groups inside it as sums, its first and last group as a row each."""
    of: dict = {}
    for i, part, fold, held, w in trials:
        of.setdefault(part, {}).setdefault((fold, held), []).append((i, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []  # weight, row of the batch and end (none inside), score, cost, best, bad, total, n
            for row, part in enumerate(batch.column(PART).to_pylist()):
                read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: E731,B023
                if part not in of:
                    continue
                codes, folds, costs = read("code", "<i4"), read("fold", "<i4"), read("t", "<f8")
                f, last = read("f", "<f8").reshape(-1, len(codes)), codes[-1]
                for (fold, held), vectors in of[part].items():
                    seen = np.flatnonzero((folds == fold) == held)
                    if not len(seen):
                        continue
                    code, t, x = codes[seen], costs[seen], f[:, seen]
                    starts = np.flatnonzero(np.diff(code, prepend=-1))
                    group = code[starts]
                    lengths = np.diff(starts, append=len(code))
                    with np.errstate(all="ignore"):
                        best = np.minimum.reduceat(np.where(np.isfinite(t) & (t > 0), t, np.inf), starts)
                        inside = (group > 0) & (group < last)
                        edges = np.flatnonzero(~inside).tolist()
                        for i, w in vectors:
                            score = _rounded(reduce(lambda a, b: a + b, [c * y for c, y in zip(w, x)]))
                            wrong = np.isnan(score)
                            score[wrong] = np.inf
                            bad = np.add.reduceat(wrong.astype(np.int64), starts)
                            low = np.minimum.reduceat(score, starts)
                            hits = np.flatnonzero(score == np.repeat(low, lengths))
                            picked = t[hits[np.flatnonzero(np.diff(code[hits], prepend=-1))]]
                            rel = np.where(np.isfinite(best), picked / best, np.nan)
                            good = inside & np.isfinite(rel) & (rel > 0)
                            if inside.any():
                                out.append((i, None, None, None, None, None, int(bad[inside].sum()), float(np.log(rel[good]).sum()), int(good.sum())))
                            for e in edges:
                                out.append((i, row, bool(group[e]), float(low[e]), float(picked[e]), float(best[e]), int(bad[e]), None, None))
            n = batch.num_rows
            take = pa.array([None if o[1] is None else o[1] + n * o[2] for o in out], pa.int64())
            ends = [pa.concat_arrays([batch.column(f"a_{g}"), batch.column(f"z_{g}")]).take(take) for g in groups]
            column = lambda k, kind: pa.array([o[k] for o in out], kind)  # noqa: E731,B023
            at = pa.concat_arrays([batch.column("at"), batch.column("at")]).take(take)
            yield pa.RecordBatch.from_arrays(
                [column(0, pa.int32()), pa.array([o[1] is not None for o in out], pa.bool_()), at, *ends, *[column(k, pa.float64()) for k in (3, 4, 5)], column(6, pa.int64()), column(7, pa.float64()), column(8, pa.int64())],
                ["weight_id", "edge", "at", *[f"g_{g}" for g in groups], "score", "t", "best", "bad", "total", "n"],
            )

    return run


def regret_parts(rows: Measurements | Packed, features: list[str], trials: list[tuple[Hashable, int, bool, list[float]]]) -> list[float | None]:
    """The regret of each trial (part, fold, held out or training, weights), none where infeasible or without rows; one pass for all.

    What regret_batch gives on each trial's rows, without a shuffle of the rows: tasks pick inside their blocks,
    and only the first and last group of a block are put together with other blocks'.
    """
    packed = rows if isinstance(rows, Packed) else pack(rows, features)
    kinds, keys = dict(packed.blocks.dtypes), [f"g_{g}" for g in packed.groups]
    schema = "weight_id int, edge boolean, at long, " + "".join(f"`g_{g}` {kinds[f'a_{g}']}, " for g in packed.groups) + "score double, t double, best double, bad long, total double, n long"
    own = [(i, part, fold, held, [float(x) for x in w]) for i, (part, fold, held, w) in enumerate(trials)]
    tried = packed.blocks.mapInArrow(_tried(packed.groups, own), schema)
    per = tried.groupBy("weight_id", "edge", *keys).agg(F.min_by("t", F.struct("score", "at")).alias("t"), C.best_of(F.col("best")).alias("best"), F.sum("bad").alias("bad"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    rel = F.col("t") / F.col("best")
    per = per.select("weight_id", "bad", F.when(F.col("edge"), F.when(C.usable(rel), F.log(rel))).otherwise(F.col("total")).alias("total"), F.when(F.col("edge"), C.usable(rel).cast("long")).otherwise(F.col("n")).alias("n"))
    sums = per.groupBy("weight_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    got = {r.weight_id: r.regret for r in sums.select("weight_id", F.when((F.col("bad") == 0) & (F.col("n") > 0), F.exp(F.col("total") / F.col("n"))).alias("regret")).collect()}  # a row for each trial
    if packed is not rows:
        packed.blocks.unpersist()
    return [got.get(i) for i in range(len(trials))]


def descend_parts(rows: Measurements | Packed, features: list[str], starts: dict[Hashable, tuple[Hashable, int, list[float]]], steps: tuple[float, ...] = STEPS, pairs: bool = True, bounds: list[tuple[float, float]] | None = None, budget: int = 400, held: bool = False) -> dict[Hashable, list[tuple[str, float, list[float]]]]:
    """Many fits in lockstep: for each name of starts (part, fold, weights) the log of its descent on the part's rows outside the fold (held: inside).

    A round is one pass that tries what all fits want to try, each on its own rows; so the passes are those of
    the longest descent, whatever the number of fits.
    """
    packed = rows if isinstance(rows, Packed) else pack(rows, features)

    def ask(wanted):
        flat = [(k, w) for k, tries in wanted.items() for w in tries]
        got, out = regret_parts(packed, features, [(*starts[k][:2], held, w) for k, w in flat]), {k: [] for k in wanted}
        for (k, _), r in zip(flat, got):
            out[k].append(r)
        return out

    ends = _lockstep(ask, {k: _descent(w, steps, pairs, bounds, budget) for k, (_, _, w) in starts.items()})
    if packed is not rows:
        packed.blocks.unpersist()
    return ends


def descend(mt: Measurements, features: list[str], start: list[float], steps: tuple[float, ...] = STEPS, pairs: bool = True, bounds: list[tuple[float, float]] | None = None, budget: int = 400) -> list[tuple[str, float, list[float]]]:
    """(kind, regret, weights) of the start and each strict improvement, see _descent; each batch is one pass over all rows."""
    rows = mt.of(mt.rows.withColumns({PART: F.lit(0), FOLD: F.lit(0)}))
    return descend_parts(rows, features, {0: (0, 0, start)}, steps, pairs, bounds, budget, held=True)[0]


def coordinate_fit(mt: Measurements, features: list[str], start: list[float], steps: tuple[float, ...] = STEPS, pairs: bool = True, restarts: int = 0, bounds: list[tuple[float, float]] | None = None, budget: int = 400, train: Column | None = None, seed: int = 5) -> DataFrame:
    """round, kind, regret, val_regret, weights: the start, each improvement and each restart that is better than all before.

    Restarts begin at seeded points around the best weights so far. Only the rows of train are fitted; the others
    give val_regret, null without them. The result is never worse than the start. The rows are packed once and
    kept in memory and on disk while the batches run; what an executor loses is computed again.
    """
    spark = mt.rows.sparkSession
    packed = pack(mt.of(mt.rows.withColumns({PART: F.lit(0), FOLD: (train if train is not None else F.lit(True)).cast("int")})), features)
    fitted = lambda w: descend_parts(packed, features, {0: (0, 1, w)}, steps, pairs, bounds, budget, held=True)[0]
    try:
        log = fitted(start)
        rng = np.random.default_rng(seed)
        for _ in range(restarts):
            _, value, best = log[-1]
            again = fitted([x + float(rng.normal(0.0, RESTART_SPREAD * max(abs(x), 1.0))) for x in best])
            if again[-1][1] < value - 1e-12:
                log.append(("restart", *again[-1][1:]))
        held = regret_parts(packed, features, [(0, 0, True, w) for *_, w in log]) if train is not None else [None] * len(log)
    finally:
        packed.blocks.unpersist()
    return spark.createDataFrame([(i, kind, value, held[i], w) for i, (kind, value, w) in enumerate(log)], "round int, kind string, regret double, val_regret double, weights array<double>")


def constant_parts(mt: Measurements, features: list[str]) -> DataFrame:
    """part, fold, n (groups), and for each feature whether it is constant inside every group (g_) and over all rows (a_)."""
    per = mt.rows.groupBy(PART, FOLD, *mt.groups).agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features])
    same = [F.every(F.col(f"lo_{f}") == F.col(f"hi_{f}")).alias(f"g_{f}") for f in features] + [(F.min(f"lo_{f}") == F.max(f"hi_{f}")).alias(f"a_{f}") for f in features]
    return per.groupBy(F.col(PART).alias("part"), F.col(FOLD).alias("fold")).agg(F.count("*").alias("n"), *same)


def transfer_cells(tables: dict[str, tuple[Measurements, list[float]]], features: list[str], fold: Column, folds: int, others: dict[str, Callable[[Measurements], DataFrame]], steps: tuple[float, ...] = (1.0, 0.3)) -> DataFrame:
    """For each fold and pair of tables: regrets on the target's held-out groups and what differs between the two.

    as_is: the source's weights fitted on its own training groups; refit: those fitted again on the target's;
    native: the target's own weights fitted there; others: baselines by name, each giving (part, fold, value)
    for the held-out groups of all tables, whose columns are those of the tables and PART and FOLD. moved: the
    second fit changed the weights; level_flips: features that are constant inside groups in one table only;
    constant: features with one value on the target's held-out groups. All fits of a kind step together.
    """
    mt = next(iter(tables.values()))[0]
    spark, cols = mt.rows.sparkSession, [*mt.groups, *mt.ids, mt.cost, *features]
    every = reduce(lambda a, b: a.unionByName(b), [m.rows.select(*cols, F.lit(k).alias(PART), fold.cast("int").alias(FOLD)) for k, (m, _) in tables.items()])
    every = mt.of(every.persist())  # on disk where memory is short, computed again where an executor goes
    packed = pack(every, features)
    cells = [(i, src, dst) for i in range(folds) for src in tables for dst in tables if src != dst]
    own = descend_parts(packed, features, {(k, i): (k, i, w) for k, (_, w) in tables.items() for i in range(folds)}, steps, pairs=False)
    again = descend_parts(packed, features, {c: (c[2], c[0], own[c[1], c[0]][-1][2]) for c in cells}, steps, pairs=False)
    weights = {(i, src, dst): (own[src, i][-1][2], again[i, src, dst][-1][2], own[dst, i][-1][2]) for i, src, dst in cells}
    got = regret_parts(packed, features, [(c[2], c[0], True, w) for c in cells for w in weights[c]])
    packed.blocks.unpersist()
    kinds = {(r.part, r.fold): r.asDict() for r in constant_parts(every, features).collect()}  # a row for each table and fold
    beside = {name: {(r.part, r.fold): r.value for r in f(every).collect()} for name, f in others.items()}  # the same
    out = []
    for n, (i, src, dst) in enumerate(cells):
        a, b = kinds.get((src, i), {}), kinds.get((dst, i), {})
        flips = sum(a.get(f"g_{f}") != b.get(f"g_{f}") for f in features)
        out.append((i, src, dst, b.get("n", 0), *got[3 * n : 3 * n + 3], *[x.get((dst, i)) for x in beside.values()], weights[i, src, dst][0] != weights[i, src, dst][1], flips, sum(bool(b.get(f"a_{f}")) for f in features)))
    every.rows.unpersist()
    names = "".join(f"{n} double, " for n in others)
    return spark.createDataFrame(out, f"fold int, src string, dst string, n long, as_is double, refit double, native double, {names}moved boolean, level_flips int, constant int")


def _softplus(d: Column) -> Column:
    return F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def rank_loss(pairs: DataFrame, score_a: Column, score_b: Column, first: Column | None = None, share: float = 0.0) -> DataFrame:
    """Weighted mean of softplus(score_a - score_b) over pairs whose first is cheaper.

    Where first is given (a condition: the pair holds its group's cheapest), the loss is (1 - share) of the mean
    over all pairs and share of the mean over these, each by its own weights; n and n_first count both. A set
    without pairs leaves the loss null.
    """
    loss = _softplus(score_a - score_b)
    mean = lambda w: F.sum(w * loss) / F.sum(w)
    if first is None:
        return pairs.agg(mean(F.col("weight")).alias("loss"), F.count("*").alias("n"))
    top = F.when(first, F.col("weight"))
    return pairs.agg(((1 - share) * mean(F.col("weight")) + share * mean(top)).alias("loss"), mean(F.col("weight")).alias("every"), mean(top).alias("first"), F.count("*").alias("n"), F.count_if(first).alias("n_first"))


def pair_sums(pairs: DataFrame, features: list[str], first: Column) -> DataFrame:
    """Pairs of the same differences as one, with the sum of their weights and first: rank_fit and the losses of a linear score are those of all pairs."""
    d = [(F.col(f"{f}_a") - F.col(f"{f}_b")).alias(f"{f}_a") for f in features]
    sums = pairs.select(*d, first.alias("first"), "weight").groupBy(*[f"{f}_a" for f in features], "first").agg(F.sum("weight").alias("weight"))
    return sums.withColumns({f"{f}_b": F.lit(0.0) for f in features})


def rank_fit(pairs: DataFrame, features: list[str], iterations: int = 50, first: Column | None = None, share: float = 0.0) -> list[float]:
    """Weights that minimise the pair loss: logistic regression on the differences, each pair in both directions.

    The first-place term is a second weight of its pairs: the loss of both sets is one weighted sum.
    """
    if first is not None:
        top = F.when(first, F.col("weight")).otherwise(0.0)
        sums = pairs.agg(F.sum("weight").alias("every"), F.sum(top).alias("top"))  # one row
        pairs = pairs.withColumn("__top", top).crossJoin(F.broadcast(sums)).withColumn("weight", ((1 - share) * F.col("weight") / F.col("every") + share * F.col("__top") / F.col("top")) * F.col("every"))
    d = [(F.col(f"{f}_a") - F.col(f"{f}_b")).alias(f) for f in features]
    one = pairs.select(*d, "weight", F.lit(0.0).alias("label"))
    both = one.unionByName(one.select(*[(-F.col(f)).alias(f) for f in features], "weight", F.lit(1.0).alias("label")))
    rows = VectorAssembler(inputCols=features, outputCol="vector").transform(both)
    model = LogisticRegression(featuresCol="vector", weightCol="weight", fitIntercept=False, maxIter=iterations, standardization=False, regParam=1e-4).fit(rows)
    return np.asarray(model.coefficients.toArray()).tolist()


def _spreads(mt: Measurements, features: list[str], weights: list[float]) -> DataFrame:
    score = reduce(lambda a, b: a + b, [w * F.col(f) for f, w in zip(features, weights)])
    return mt.rows.withColumn("score", score).groupBy(*mt.groups).agg(*[F.stddev_pop(f).alias(f) for f in features], F.stddev_pop("score").alias("score"))


def contributions(mt: Measurements, features: list[str], weights: list[float]) -> DataFrame:
    """term, contribution: mean over groups of the spread of w f inside the group; flags for none and for over 50 times the median."""
    row = _spreads(mt, features, weights).agg(*[F.avg(F.abs(F.lit(w)) * F.col(f)).alias(f) for f, w in zip(features, weights)])
    long = row.unpivot([], features, "term", "contribution")
    mid = long.agg(C.median(F.col("contribution")).alias("mid"))
    return long.crossJoin(mid).select("term", "contribution", (F.col("contribution") == 0).alias("zero"), (F.col("contribution") > 50 * F.col("mid")).alias("dominant"))


def term_scales(mt: Measurements, features: list[str], weights: list[float]) -> DataFrame:
    """term, scale: mean spread of the feature over the score's."""
    row = _spreads(mt, features, weights).agg(*[F.avg(f).alias(f) for f in features], F.greatest(F.avg("score"), F.lit(1e-12)).alias("own"))
    return row.select(*[(F.col(f) / F.col("own")).alias(f) for f in features]).unpivot([], features, "term", "scale")


def _variants(mt: Measurements, features: list[str], vectors: list[tuple[str, list[float]]]) -> DataFrame:
    got = regret_batch(mt, features, weight_table(mt.rows.sparkSession, [v for _, v in vectors]))
    names = mt.rows.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(vectors)], "weight_id int, term string")
    return got.join(F.broadcast(names), "weight_id")


def sensitivity(mt: Measurements, features: list[str], weights: list[float], by: float = 0.5) -> DataFrame:
    """term, change: the largest change of regret when the weight moves by half, up or down."""
    tries = [("", list(weights))]
    tries += [(f, [w * (1 + (d if i == j else 0)) for j, w in enumerate(weights)]) for i, f in enumerate(features) for d in (-by, by)]
    rows = _variants(mt, features, tries)
    base = rows.where("term = ''").select(F.col("regret").alias("base"))
    return rows.where("term <> ''").crossJoin(F.broadcast(base)).groupBy("term").agg(F.max(F.abs(F.col("regret") - F.col("base"))).alias("change"))


def drop_terms(mt: Measurements, features: list[str], weights: list[float]) -> DataFrame:
    """term, regret: with its weight at zero and the others fixed."""
    tries = [(f, [0.0 if i == j else w for j, w in enumerate(weights)]) for i, f in enumerate(features)]
    return _variants(mt, features, tries).select("term", "regret")


def dead_terms(fit: DataFrame) -> DataFrame:
    """Terms of fit(term, weight, change) that are dead by weight, or by sensitivity with a weight."""
    small = F.abs("weight") < 1e-3
    return fit.withColumn("dead", F.when(small, "weight").when(F.col("change") < 1e-6, "sensitivity")).where("dead IS NOT NULL")


def term_caps(mt: Measurements, features: list[str], main: str, lam: float) -> DataFrame:
    """term, lo, hi: bounds of weights so that a term moves no more than the main one.

    R is a group's p1..p99 range of a column (its whole range where that is flat). The bound is lam times the
    tenth percentile over groups of R(main) / R(term); the main term's is half to twice its median; a term
    that never moves is held at zero.
    """
    def r(c: str) -> Column:
        q = F.percentile(c, F.array(F.lit(0.01), F.lit(0.99)))
        return F.when(q[1] - q[0] > 0, q[1] - q[0]).otherwise(F.max(c) - F.min(c))

    per = mt.rows.groupBy(*mt.groups).agg(*[r(c).alias(c) for c in dict.fromkeys([*features, main])])
    ratios = per.select(*[F.when((F.col(f) > 0) & (F.col(main) > 0), F.col(main) / F.col(f)).alias(f"r_{f}") for f in features])
    long = ratios.select(*[F.col(f"r_{f}").alias(f) for f in features]).unpivot([], features, "term", "ratio")
    q = long.groupBy("term").agg(F.percentile("ratio", F.array(F.lit(0.1), F.lit(0.5))).alias("q"))
    is_main, none = F.col("term") == main, F.col("q").isNull()
    hi = F.when(none, 0.0).when(is_main, 2.0 * F.col("q")[1]).otherwise(lam * F.col("q")[0])
    lo = F.when(none, 0.0).when(is_main, 0.5 * F.col("q")[1]).otherwise(-lam * F.col("q")[0])
    return q.select("term", lo.alias("lo"), hi.alias("hi"))
