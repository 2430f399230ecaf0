"""Iterative and fitted operators against small recomputations and planted structure."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candrank.functions.columns import Noise
from candrank.functions.features import PHYSICAL, with_features
from candrank.operators import baselines, cross, fit, quality, rank, splits
from candrank.table import Measurements


@pytest.fixture(scope="module")
def planted(spark):
    """Cost rises with 2 f0 - f1."""
    r = np.random.default_rng(1)
    rows = [(g, k, float(np.exp(0.5 * (2 * a - b)) * (1 + 0.001 * r.random())), float(a), float(b)) for g in range(12) for k, (a, b) in enumerate(r.random((15, 2)))]
    return Measurements(spark.createDataFrame(rows, "g long, k long, t double, f0 double, f1 double"), ("g",), ("k",), noise=Noise(0, 0, 0))


def greedy(rows, k):
    """Ids one after the other, each the one that makes the objective of the chosen set least."""
    costs = {}
    for g, i, t, *_ in rows:
        costs.setdefault(g, {}).setdefault(i, []).append(t)

    def objective(chosen):
        total = 0.0
        for own in costs.values():
            best = min(min(ts) for ts in own.values())
            reached = [math.log(t / best) for i in chosen for t in own.get(i, [])]
            total += min(reached, default=math.log(1000))
        return round(total / len(costs), 9)

    out = []
    for _ in range(k):
        free = sorted({i for own in costs.values() for i in own} - {i for i, _ in out})
        out.append(min(((i, objective([c for c, _ in out] + [i])) for i in free), key=lambda x: (x[1], x[0])))
    return out


def test_static_topk(planted, tmp_path):
    rows = [tuple(r) for r in planted.rows.where("(g + k) % 4 <> 0").collect()]
    got = baselines.static_topk(planted.where("(g + k) % 4 <> 0"), ("k",), 4, str(tmp_path)).collect()
    assert [(r.k, r.objective) for r in got] == [(i + 1, pytest.approx(o, abs=1e-8)) for i, (_, o) in enumerate(greedy(rows, 4))]


def test_fit_recovers_direction(planted):
    log = fit.coordinate_fit(planted, ["f0", "f1"], [-0.5, 0.5]).collect()
    regrets = [r.regret for r in log]
    assert regrets == sorted(regrets, reverse=True) and regrets[-1] < 0.5 * regrets[0]
    assert log[-1].weights[0] > 0


def test_ridge_and_trees_beat_a_constant(planted):
    train = F.col("g") < 8
    for rows, score in ((baselines.ridge(planted, ["f0", "f1"], train)[0].where(~train), "score"), (baselines.gbdt(planted, ["f0", "f1"], train, 10, 3)[0], "prediction")):
        r = rows.withColumn("n", F.min(score).over(planted.per_group())).where(F.col(score) == F.col("n")).agg(F.avg(F.col("t") / F.col("best"))).first()[0]
        mean = rows.agg(F.avg(F.col("t") / F.col("best"))).first()[0]
        assert r < 0.8 * mean


def test_trees_on_categories(spark):
    r = np.random.default_rng(3)
    rows = [(g, k, {"a": 1.0, "b": 3.0, "c": 2.0}[c] * (1 + 0.01 * r.random()), float(r.random()), c) for g in range(20) for k, c in enumerate(r.choice(list("abc"), 12))]
    mt = Measurements(spark.createDataFrame(rows, "g long, k long, t double, f0 double, c string"), ("g",), ("k",), noise=Noise(0, 0, 0))
    out, importance = baselines.gbdt(mt, ["f0"], F.col("g") < 15, 5, 2, {"c": ("a", "b", "c")})
    assert importance["c"] > 0.9 and set(importance) == {"f0", "c"} and "__c" not in out.columns
    low = out.groupBy("g").agg(F.min_by("c", "prediction").alias("c")).collect()
    assert len(low) == 5 and all(x.c == "a" for x in low)
    with pytest.raises(Exception, match="not one of its levels"):
        baselines.gbdt(mt, ["f0"], F.col("g") < 15, 2, 2, {"c": ("a", "b")})


def test_fit_with_pairs_restarts_and_held_groups(planted):
    fitted = fit.coordinate_fit(planted, ["f0", "f1"], [-0.5, 0.5], steps=(1.0, 0.3), restarts=2, train=F.col("g") < 8)
    log = fitted.orderBy("round").collect()
    regrets = [r.regret for r in log]
    assert log[0].kind == "start" and regrets == sorted(regrets, reverse=True) and {r.kind for r in log} <= {"start", "single", "pair", "restart"}
    held = planted.where("g >= 8")
    want = fit.regret_batch(held, ["f0", "f1"], fit.weight_table(held.rows.sparkSession, [r.weights for r in log])).collect()
    assert {i: r.val_regret for i, r in enumerate(log)} == pytest.approx({r.weight_id: r.regret for r in want})
    inside = fit.coordinate_fit(planted, ["f0", "f1"], [5.0, 5.0], steps=(1.0,), bounds=[(-1, 1), (-1, 1)]).collect()
    assert all(abs(w) <= 1 for r in inside for w in r.weights)
    # of two weights that must move together only a pair step helps
    assert len(fit._pairs([1.0, 2.0, 3.0], 0.5)) == 12 and fit._singles([0.0, 2.0], 0.5) == [[-0.5, 2.0], [0.5, 2.0], [0.0, 1.0], [0.0, 3.0]]


def test_rank_fit_finds_the_direction(planted):
    pairs = planted.rows.alias("a").join(planted.rows.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.t") < F.col("b.t")))
    pairs = pairs.select(*[F.col(f"{s}.{f}").alias(f"{f}_{s}") for s in "ab" for f in ("f0", "f1")], F.lit(1.0).alias("weight"))
    w = fit.rank_fit(pairs, ["f0", "f1"])
    assert w[0] > 0 > w[1] and 1 < w[0] / -w[1] < 4
    loss = fit.rank_loss(pairs, w[0] * F.col("f0_a") + w[1] * F.col("f1_a"), w[0] * F.col("f0_b") + w[1] * F.col("f1_b")).first().loss
    assert loss < math.log(2)


def test_transfer_cells(planted):
    other = planted.of(planted.rows.withColumn("t", F.exp(0.5 * (F.col("f1") - F.col("f0")))).withColumn("f1", F.col("f1")))
    none = lambda every: every.rows.groupBy(F.col(fit.PART).alias("part"), F.col(fit.FOLD).alias("fold")).agg(F.count("*").cast("double").alias("value"))
    got = fit.transfer_cells({"a": (planted, [1.0, 0.0]), "b": (other, [0.0, 1.0])}, ["f0", "f1"], F.col("g") % 2, 2, {"none": none}).collect()
    assert {(r.fold, r.src, r.dst) for r in got} == {(f, *x) for f in (0, 1) for x in (("a", "b"), ("b", "a"))}
    tables = {"a": (planted, [1.0, 0.0]), "b": (other, [0.0, 1.0])}
    for r in got:  # each cell as fits of its own, one after the other
        train, held = ({k: m.where(f"g % 2 {op} {r.fold}") for k, (m, _) in tables.items()} for op in ("<>", "="))
        own = {k: fit.descend(train[k], ["f0", "f1"], w, (1.0, 0.3), pairs=False)[-1][2] for k, (_, w) in tables.items()}
        again = fit.descend(train[r.dst], ["f0", "f1"], own[r.src], (1.0, 0.3), pairs=False)[-1][2]
        want = fit.regret_batch(held[r.dst], ["f0", "f1"], fit.weight_table(planted.rows.sparkSession, [own[r.src], again, own[r.dst]])).orderBy("weight_id").collect()
        assert [r.as_is, r.refit, r.native] == pytest.approx([x.regret for x in want]) and r.moved == (again != own[r.src])
        assert r.n == 6 and r.none == held[r.dst].rows.count() and r.level_flips == r.constant == 0


def test_fits_in_lockstep(planted):
    """Many descents together give what each gives alone, pairs, bounds and budgets included, in as many passes as the longest takes."""
    rows = planted.of(planted.rows.withColumns({fit.PART: F.when(F.col("g") < 6, "x").otherwise("y"), fit.FOLD: (F.col("g") % 3).cast("int")}))
    starts = {("x", 0, 0): ("x", 0, [1.0, 0.0]), ("x", 0, 1): ("x", 0, [-0.5, 0.5]), ("y", 2, 0): ("y", 2, [1.0, 0.0])}
    for extra in ({"steps": (1.0, 0.3), "bounds": [(-1, 1), (-1, 1)]}, {"steps": (1.0,), "budget": 9, "pairs": False}):
        passes = []
        ask = fit.regret_parts
        try:
            fit.regret_parts = lambda *a: passes.append(1) or ask(*a)  # noqa: B023
            got = fit.descend_parts(rows, ["f0", "f1"], starts, **extra)
        finally:
            fit.regret_parts = ask
        longest = 0
        for name, (p, i, w) in starts.items():
            alone = planted.where(f"g {'<' if p == 'x' else '>='} 6 AND g % 3 <> {i}")
            want = fit.descend(alone, ["f0", "f1"], w, **extra)
            assert [(k, round(v, 9), x) for k, v, x in got[name]] == [(k, round(v, 9), x) for k, v, x in want]
            longest = max(longest, len(want))
        assert len(passes) <= 2 * longest + 2 * len(extra["steps"]) + 2


def test_first_place_term(planted):
    pairs = planted.rows.alias("a").join(planted.rows.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.t") < F.col("b.t")))
    best = planted.rows.groupBy(F.col("g").alias("of")).agg(F.min("t").alias("m"))
    pairs = pairs.join(best, F.col("a.g") == F.col("of")).select(*[F.col(f"{s}.{f}").alias(f"{f}_{s}") for s in "ab" for f in ("f0", "f1")], (F.col("b.t") - F.col("a.t")).alias("weight"), (F.col("a.t") == F.col("m")).alias("first"))
    rows, d = pairs.collect(), lambda r: r.f0_a - r.f0_b
    mean = lambda rs: sum(r.weight * np.logaddexp(0, d(r)) for r in rs) / sum(r.weight for r in rs)
    got = fit.rank_loss(pairs, F.col("f0_a"), F.col("f0_b"), F.col("first"), 0.25).first()
    top = [r for r in rows if r.first]
    assert got.loss == pytest.approx(0.75 * mean(rows) + 0.25 * mean(top)) and (got.n, got.n_first) == (len(rows), len(top))
    # pairs that pull one way and, fewer, first places that pull the other
    r = np.random.default_rng(5)
    rows = [(float(x), 0.0, 1.0, bool(i % 4 == 0)) for i, x in enumerate(np.where(np.arange(200) % 4 == 0, -1, 1) * (1 + r.random(200)) * np.where(r.random(200) < 0.8, 1, -1))]
    mixed = planted.rows.sparkSession.createDataFrame(rows, "f0_a double, f0_b double, weight double, first boolean")
    w = {share: fit.rank_fit(mixed, ["f0"], first=F.col("first"), share=share)[0] for share in (0.0, 0.5, 1.0)}
    assert w[0.0] < 0 < w[1.0] and w[0.0] < w[0.5] < w[1.0] and fit.rank_fit(mixed, ["f0"]) == pytest.approx([w[0.0]], rel=1e-3)


def test_deal_is_the_greedy_deal():
    r = random.Random(1)
    for case in range(60):
        k = r.choice([1, 2, 5, 7])
        sizes = sorted({(r.choice([1, 2, 3, 10, 50, 1000]), r.choice([0, 1])) for _ in range(r.randint(1, 7))}, key=lambda x: (-x[0], x[1]))
        classes = [(n, o, r.choice([1, 2, 9, 300])) for n, o in sizes]
        load, want = [(0, 0, i) for i in range(k)], []
        for n, o, c in classes:
            for _ in range(c):
                at = min(load)
                load[at[2]] = (at[0] + n, at[1] + o, at[2])
                want.append(at[2])
        got = []
        for n, o, begin, end, turn in splits.deal(classes, k):
            got += [turn[i % len(turn)] for i in range(end - begin)]
        assert got == want, (k, classes)
    assert len(splits.deal([(10**9, 0, 1), (1, 0, 10**9)], 5)) < 20  # rounds are not dealt one by one


def test_grouped_folds(spark):
    rows = [(i, b) for b in range(40) for i in range(1 + b * b % 23)]
    groups = spark.createDataFrame(rows, "i long, b long")
    got = splits.grouped_folds(groups, ["b"], 4, F.col("i") % 2 == 0).collect()
    assert len(got) == 40 and {r.b: r.n for r in got} == {b: 1 + b * b % 23 for b in range(40)}
    load, want = {i: (0, 0, i) for i in range(4)}, {}
    for b in sorted(range(40), key=lambda b: (-(1 + b * b % 23), (1 + b * b % 23) // 2, hashlib.md5(str(b).encode()).hexdigest())):
        at = min(load.values())
        n = 1 + b * b % 23
        load[at[2]] = (at[0] + n, at[1] + n // 2, at[2])
        want[b] = at[2]
    assert {r.b: r.fold for r in got} == want


@pytest.mark.parametrize("kind", ["even", "ties", "constant"])
def test_sample_spread(spark, kind):
    r = random.Random(kind)
    values = {"even": [r.random() for _ in range(300)], "ties": [float(r.randint(0, 5)) for _ in range(300)], "constant": [1.0] * 300}[kind]
    groups = spark.createDataFrame(list(enumerate(values)), "g long, v double")
    taken = []
    for i in range(9):
        target = float(np.quantile(values, (i + 0.5) / 9))
        taken.append(min((g for g in range(300) if g not in taken), key=lambda g: (abs(values[g] - target), values[g], g)))
    assert sorted(x.g for x in splits.sample_spread(groups, "g", "v", 9).collect()) == sorted(taken)
    assert splits.sample_spread(groups.limit(3), "g", "v", 9).count() == 3 and splits.sample_spread(groups.limit(0), "g", "v", 9).count() == 0


def test_features_refuse_what_is_not_finite(spark):
    base = {"M": 64, "N": 64, "K": 64, "tile_m": 32, "tile_n": 32, "tile_k": 32, "split_k": 1, "threads": 128, "max_blocks_per_sm": 2, "smem_bytes": 8192, "regs_per_thread": 64, "spill_bytes": 0, "inst_total": 10, "sm_count": 84, "smem_per_block": 101376, "max_threads_per_sm": 1536, "regs_per_sm": 65536}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()], F.lit("f16").alias("dtype"), F.lit("serial").alias("split_k_mode"), F.lit("multistage").alias("pipeline_kind"), F.lit(159.1).alias("ridge_point"))
    row = with_features(df, PHYSICAL).first()
    assert row.edge_waste == 0 and row.waves == 4 / 168 and row.log_workspace_bytes == 0 and row.can_use_cp_async == 1
    for broken in (df.withColumn("dtype", F.lit("f12")), df.withColumn("M", F.lit(None).cast("int"))):
        with pytest.raises(Exception):
            with_features(broken, PHYSICAL).collect()


def test_ridge_with_categories(spark):
    """The sums of levels give what a dense one-hot matrix does; an unknown level is an error."""
    r = np.random.default_rng(8)
    rows = [(g, k, float(1 + r.random() + (k % 3)), float(r.random()), float(r.random() * 9), "abc"[k % 3], "xy"[int(r.integers(2))]) for g in range(30) for k in range(9)]
    mt = Measurements(spark.createDataFrame(rows, "g long, k long, t double, f0 double, f1 double, c string, d string"), ("g",), ("k",), noise=Noise(0, 0, 0))
    levels = {"c": ("a", "b", "c"), "d": ("x", "y", "z")}
    out, w = baselines.ridge(mt, ["f0", "f1"], F.col("g") < 20, 2.0, levels)
    best = {g: min(x[2] for x in rows if x[0] == g) for g in range(30)}
    num = np.array([x[3:5] for x in rows])
    train = np.array([x[0] < 20 for x in rows])
    num = (num - num[train].mean(0)) / num[train].std(0)
    a = np.hstack([num, *[np.array([x[5 + i] == v for x in rows], float)[:, None] for i, vs in enumerate(levels.values()) for v in vs]])
    y = np.array([best[x[0]] / x[2] for x in rows])
    m = a[train].mean(0)
    coef = np.linalg.solve((a[train] - m).T @ (a[train] - m) + 2.0 * np.eye(a.shape[1]), (a[train] - m).T @ (y[train] - y[train].mean()))
    want = dict(zip([x[:2] for x in rows], -((a - m) @ coef + y[train].mean())))
    assert {(x.g, x.k): x.score for x in out.collect()} == pytest.approx(want) and len(w) == 8
    assert out.columns == [*mt.rows.columns, "best", "y", "score"]
    with pytest.raises(Exception, match="not one of its levels"):
        baselines.ridge(mt, ["f0"], F.col("g") < 20, 1.0, {"c": ("a", "b")})[0].collect()


@pytest.mark.parametrize("nearest", [True, False])
def test_recommended_order(spark, nearest):
    r = random.Random(4)
    rows = [(g, i, r.randrange(5), r.randrange(1, 40), 1.0) for g in range(15) for i in range(r.randrange(1, 25))]
    wishes = [(g, w, r.choice([*range(6), None]), r.randrange(1, 40)) for g in range(17) for w in range(r.randrange(5))] + [(3, 9, 1, None)]
    mt = Measurements(spark.createDataFrame(rows, "g long, i long, a long, b long, t double"), ("g",), ("i",), noise=Noise(0, 0, 0))
    asked = spark.createDataFrame(wishes, "g long, wish long, a long, b long").withColumn("x", F.lit(1))
    got = cross.recommended(asked, mt, ("a", "b"), (1.0, 4.0), nearest).ranked("wish").orderBy("g", "rn").collect()
    scale = lambda x: math.log2(max(x, 1) + 1)
    for g in range(15):
        own = [x for x in rows if x[0] == g]
        order = []
        for _, _, a, b in sorted((w for w in wishes if w[0] == g and None not in w), key=lambda w: w[1]):
            exact = [x[1] for x in own if x[2:4] == (a, b)]
            if not exact and not nearest:
                continue
            near = min(own, key=lambda x: (round((scale(x[2]) - scale(a)) ** 2 + 4 * (scale(x[3]) - scale(b)) ** 2, 9), x[1]))[1]
            order.append(min(exact) if exact else near)
        order = [*dict.fromkeys(order)]
        assert [x.i for x in got if x.g == g] == order + sorted(x[1] for x in own if x[1] not in order)


def test_hits_without_sorting_groups(spark):
    r = random.Random(6)
    rows = [(g, i, float(r.randrange(1, 6)), float(r.randrange(4))) for g in range(12) for i in range(r.choice([1, 7, 40]))] + [(99, 0, float("nan"), 1.0), (99, 1, -1.0, 0.0)]
    mt = Measurements(spark.createDataFrame(rows, "g long, i long, t double, s double"), ("g",), ("i",), noise=Noise(0.3, 0.0, 0.0))
    got = {x.pct: (x.hit_best, x.hit_answer) for x in rank.hit_at_pct(mt, "s", (1, 20, 50)).collect()}
    for pct in (1, 20, 50):
        hits = []
        for g in sorted({x[0] for x in rows}):
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[3], x[1]))
            costs = [x[2] for x in own if x[2] > 0]
            top = own[: max(1, math.ceil(len(own) * pct / 100))]
            best = min(costs, default=None)
            hits.append((best is not None and any(x[2] == best for x in top), best is not None and any(x[2] <= best * (1 + 2 * 0.3 / best) for x in top if x[2] == x[2])))
        assert got[pct] == pytest.approx(tuple(sum(h[k] for h in hits) / len(hits) for k in (0, 1)))


def test_samples(spark):
    r = random.Random(9)
    groups = [(i, "abcd"[min(3, r.randrange(9))], r.random() * 2, r.random()) for i in range(200)]
    df = spark.createDataFrame(groups, "g long, s string, ratio double, v double")
    sizes = {s: sum(x[1] == s for x in groups) for s in "abcd"}
    got = splits.sample_stratified(df, ["g"], "s", 41, proportional=True).groupBy("s").count().collect()
    part = {s: math.floor(n / 200 * 37) for s, n in sizes.items()}
    want = {s: 1 + part[s] + (i < 37 - sum(part.values())) for i, s in enumerate("abcd")}
    assert {x.s: x["count"] for x in got} == want and sum(want.values()) == 41
    with pytest.raises(Exception, match="more strata"):
        splits.sample_stratified(df, ["g"], "s", 3, proportional=True).collect()
    near = [x[0] for x in sorted(groups, key=lambda x: (abs(x[2] - 1), x[0]))[:9]]
    assert sorted(x.g for x in splits.sample_boundary(df, "g", "ratio", 9).collect()) == sorted(near)
    mixed = splits.sample_mixed(df, "g", "ratio", "v", 9).collect()
    assert sorted(x.g for x in mixed if x.arm == "boundary") == sorted(near[:4]) and len({x.g for x in mixed}) == 9


def test_pinned_blocks(spark):
    groups = spark.createDataFrame([(i, b) for b in range(30) for i in range(1 + b % 7)], "i long, b long")
    got = {r.b: r.fold for r in splits.grouped_folds(groups, ["b"], 3, F.lit(True), (F.col("b") == 6) & (F.col("i") == 0) | (F.col("b") == 13)).collect()}
    assert len(got) == 30 and got[6] == got[13] == 0
    load = {0: 14, 1: 0, 2: 0}
    for b in sorted((b for b in range(30) if b not in (6, 13)), key=lambda b: (-(1 + b % 7), hashlib.md5(str(b).encode()).hexdigest())):
        at = min(load, key=lambda i: (load[i], i))
        load[at] += 1 + b % 7
        assert got[b] == at
    with pytest.raises(ValueError, match="pinned"):
        splits.grouped_folds(groups, ["b"], 3, F.lit(True), F.col("b") > 99)


def test_packed_trials_are_those_of_whole_rows(spark):
    """Groups over many blocks and tasks, ties, unusable costs, missing features and two parts: as regret_batch on each trial's rows."""
    r = np.random.default_rng(9)
    rows = [(p, f"g{g}" if g else None, k, float(r.choice([0.0, math.inf, math.nan, *r.integers(1, 9, 9)])), float(r.integers(0, 4)) / 4, float(r.integers(0, 3)), int(g % 3)) for p in "xy" for g in range(9) for k in range(400 if g == 4 else 7)]
    rows[-1] = (*rows[-1][:4], None, *rows[-1][5:])
    mt = Measurements(spark.createDataFrame(rows, f"{fit.PART} string, g string, k long, t double, f0 double, f1 double, {fit.FOLD} int"), ("g",), ("k",), noise=Noise(0, 0, 0))
    trials = [(p, i, held, w) for p in "xy" for i in range(3) for held in (False, True) for w in ([1.0, 1.0], [-0.5, 0.25], [0.0, 0.0])]
    before, small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "16"
    shuffled = []
    whole = fit.regret_batch
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
        fit.regret_batch = lambda *a, **k: shuffled.append(1) or whole(*a, **k)
        got = fit.regret_parts(mt, ["f0", "f1"], trials)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        fit.regret_batch = whole
    assert not shuffled  # no pass shuffles a row for each candidate and vector
    for (p, i, held, w), value in zip(trials, got):
        one = mt.where(f"{fit.PART} = '{p}' AND {fit.FOLD} {'=' if held else '<>'} {i}")
        want = fit.regret_batch(one, ["f0", "f1"], fit.weight_table(spark, [w])).first().regret
        assert value == (want if want is None else pytest.approx(want, rel=1e-12))
    assert got.count(None) == 9


def test_pair_sums_fit_as_all_pairs(spark):
    """Pairs of few differences become as few rows, and fit and loss stay what they are on all pairs."""
    r = np.random.default_rng(11)
    rows = [(*(float(x) for x in r.integers(0, 4, 4) / 4), float(1 + r.random()), bool(r.random() < 0.3)) for _ in range(600)]
    pairs = spark.createDataFrame(rows, "f0_a double, f0_b double, f1_a double, f1_b double, weight double, head boolean")
    sums = fit.pair_sums(pairs, ["f0", "f1"], F.col("head"))
    assert sums.count() <= 2 * 49
    for share in (0.0, 0.5):
        w = fit.rank_fit(pairs, ["f0", "f1"], first=F.col("head"), share=share)
        assert fit.rank_fit(sums, ["f0", "f1"], first=F.col("first"), share=share) == pytest.approx(w, rel=1e-4, abs=1e-6)
        score = lambda s: 0.3 * F.col(f"f0_{s}") - 0.7 * F.col(f"f1_{s}")
        loss = lambda df, c: fit.rank_loss(df, score("a"), score("b"), F.col(c), share).first().loss
        assert loss(sums, "first") == pytest.approx(loss(pairs, "head"), rel=1e-9)
