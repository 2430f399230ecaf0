"""Queries on splits, samples, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators import cross, splits
from candrank.plans.core_queries import EV, GEO, PART_SQL, ST
from candrank.plans.fixtures import evaluate_sql, part, part_by_status, part_sql, read
from candrank.plans.registry import query
from candrank.table import evaluate, group_stats

A_SQL, B_SQL = part_sql("a", "WHERE l_linestatus = 'F'"), part_sql("b", "WHERE l_linestatus = 'O'")
PARTS = "p AS (SELECT p_partkey AS g, p_brand AS stratum, p_size AS size, p_retailprice AS price FROM part)"


def parts(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("g"), F.col("p_brand").alias("stratum"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


@query("g bigint, role string", f"WITH {PARTS}, h AS (SELECT *, size > 35 AS held FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY md5(concat_ws('|', g, 3)), g) AS rn, count(*) OVER (PARTITION BY held) AS n FROM h) SELECT g, CASE WHEN NOT held THEN 'train' WHEN rn <= floor(n * 0.6 + 0.5) THEN 'val' ELSE 'test' END AS role FROM r")
def split_by_predicate(spark, sf):
    return splits.split_by_predicate(parts(spark, sf), ["g"], F.col("size") > 35, 0.6, 3)


@query("g bigint, stratum string, fold bigint", f"WITH {PARTS} SELECT g, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', g, 7)), g) - 1) % 5 AS fold FROM p")
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(parts(spark, sf), ["g"], "stratum", 5, 7)


FOLD = "list_min(list_transform(range(0, 5), lambda j: (l[j + 1] * 1000000 + q[j + 1]) * 5 + j)) % 5"
#: the greedy deal, block by block
BLOCK_FOLDS = f"""{PARTS}, bs AS (SELECT stratum, size, count(*) AS n, count(*) FILTER (WHERE NOT price < 1500) AS o FROM p GROUP BY stratum, size), bo AS (SELECT *, row_number() OVER (ORDER BY n DESC, o, md5(concat_ws('|', stratum, size)), stratum, size) AS i FROM bs),
 dl AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS l, [0, 0, 0, 0, 0]::BIGINT[] AS q, NULL::BIGINT AS fold
   UNION ALL SELECT bo.i, list_transform(range(0, 5), lambda j: x.l[j + 1] + CASE WHEN j = x.f THEN bo.n ELSE 0 END), list_transform(range(0, 5), lambda j: x.q[j + 1] + CASE WHEN j = x.f THEN bo.o ELSE 0 END), x.f FROM (SELECT *, {FOLD} AS f FROM dl) x JOIN bo ON bo.i = x.i + 1),
 bf AS (SELECT bo.stratum, bo.size, bo.n, dl.fold FROM bo JOIN dl ON bo.i = dl.i)"""


@query("stratum string, size bigint, n bigint, fold bigint", f"WITH RECURSIVE {BLOCK_FOLDS} SELECT * FROM bf")
def grouped_folds(spark, sf):
    return splits.grouped_folds(parts(spark, sf), ["stratum", "size"], 5, F.col("price") < 1500)


#: the greedy deal that begins with the blocks of size 1 in the first fold
PINNED_FOLDS = (
    BLOCK_FOLDS.replace("bo AS (SELECT *,", "bp AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(o), 0)::BIGINT AS o FROM bs WHERE size = 1), bo AS (SELECT *,").replace("FROM bs),\n", "FROM bs WHERE size <> 1),\n")
    .replace("SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS l, [0, 0, 0, 0, 0]::BIGINT[] AS q, NULL::BIGINT AS fold", "SELECT 0::BIGINT AS i, [n, 0, 0, 0, 0]::BIGINT[] AS l, [o, 0, 0, 0, 0]::BIGINT[] AS q, NULL::BIGINT AS fold FROM bp")
)


@query("stratum string, size bigint, n bigint, fold bigint", f"WITH RECURSIVE {PINNED_FOLDS} SELECT * FROM bf UNION ALL SELECT stratum, size, n, 0 FROM bs WHERE size = 1")
def pinned_folds(spark, sf):
    """The parts of size 1 are held out together, as the first fold; the other blocks are dealt around them."""
    return splits.grouped_folds(parts(spark, sf), ["stratum", "size"], 5, F.col("price") < 1500, F.col("size") == 1)


@query("fold bigint, n bigint, repeated bigint, with_twins bigint, out_share double", f"WITH {PARTS}, f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', g, 7)), g) - 1) % 5 AS fold FROM p), s AS (SELECT size, count(DISTINCT fold) AS folds FROM f GROUP BY size) SELECT fold, count(*) AS n, 0 AS repeated, count(*) FILTER (WHERE folds > 1) AS with_twins, avg((NOT price < 1500)::INT) AS out_share FROM f JOIN s ON f.size = s.size GROUP BY fold")
def fold_checks(spark, sf):
    return splits.fold_checks(splits.stratified_kfold(parts(spark, sf), ["g"], "stratum", 5, 7), ["g"], ["size"], F.col("price") < 1500)


CHECKS = """f AS (SELECT p.*, fold, CASE WHEN price < 1100 THEN 'low' ELSE 'high' END AS regime, log2(price) AS v FROM p JOIN bf ON p.stratum = bf.stratum AND p.size = bf.size), sf AS (SELECT size, count(DISTINCT fold) AS folds FROM f GROUP BY size), bl AS (SELECT stratum, size, count(DISTINCT fold) AS folds FROM f GROUP BY stratum, size),
 ac AS (SELECT fold, size, count(*) AS c FROM f GROUP BY fold, size), mr AS (SELECT a.fold, b.regime, count(*) AS c FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1, 2), mi AS (SELECT fold, min(c) / sum(c) AS minority FROM mr GROUP BY fold),
 o AS (SELECT fold, v, row_number() OVER (PARTITION BY fold ORDER BY v, g) - 1 AS pl, count(*) OVER (PARTITION BY fold) AS n FROM f), q AS (SELECT fold, min(v) AS lo, max(v) FILTER (WHERE pl = n // 4) AS q1, median(v) AS mid, max(v) FILTER (WHERE pl = 3 * n // 4) AS q3, max(v) AS hi FROM o GROUP BY fold),
 tp AS (SELECT fold, max(c) / sum(c) AS top_share FROM ac GROUP BY fold)"""


@query(
    "fold bigint, n bigint, repeated bigint, with_twins bigint, out_share double, out_of_all double, attribute_twins bigint, top_share double, minority double, lo double, q1 double, mid double, q3 double, hi double",
    f"WITH RECURSIVE {BLOCK_FOLDS}, {CHECKS}, z AS (SELECT f.fold, count(*) AS n, 0 AS repeated, count(*) FILTER (WHERE bl.folds > 1) AS with_twins, avg((NOT price < 1500)::INT) AS out_share, coalesce(count(*) FILTER (WHERE NOT price < 1500) / nullif((SELECT count(*) FROM p WHERE NOT price < 1500), 0), 0.0) AS out_of_all, count(*) FILTER (WHERE sf.folds > 1) AS attribute_twins FROM f JOIN sf ON f.size = sf.size JOIN bl ON f.stratum = bl.stratum AND f.size = bl.size GROUP BY f.fold) SELECT z.*, top_share, minority, lo, q1, mid, q3, hi FROM z JOIN tp ON z.fold = tp.fold JOIN mi ON z.fold = mi.fold JOIN q ON z.fold = q.fold",
)
def fold_report(spark, sf):
    """The folds of blocks with all their checks: twins by size, the commonest size, the rarer price band in training, and the spread of the prices."""
    p = parts(spark, sf)
    folds = p.join(splits.grouped_folds(p, ["stratum", "size"], 5, F.col("price") < 1500).select("stratum", "size", "fold"), ["stratum", "size"])
    folds = folds.withColumn("regime", F.when(F.col("price") < 1100, "low").otherwise("high"))
    return splits.fold_checks(folds, ["g"], ["stratum", "size"], F.col("price") < 1500, "size", "regime", "price")


ROLES = f"{PARTS}, h AS (SELECT *, size > 35 AS held FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY md5(concat_ws('|', g, 3)), g) AS rn, count(*) OVER (PARTITION BY held) AS n FROM h), sp AS (SELECT g, stratum, price, CASE WHEN NOT held THEN 'train' WHEN rn <= floor(n * 0.6 + 0.5) THEN 'val' ELSE 'test' END AS role FROM r)"


@query("role string, regime string, n bigint, share double, minority boolean", f"WITH {ROLES}, c AS (SELECT role, CASE WHEN price < 1100 THEN 'low' ELSE 'high' END AS regime, count(*) AS n FROM sp GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY role) AS share, n / sum(n) OVER (PARTITION BY role) < 0.25 AS minority FROM c")
def regime_balance(spark, sf):
    split = splits.split_by_predicate(parts(spark, sf), ["g"], F.col("size") > 35, 0.6, 3)
    return splits.balance(split.withColumn("regime", F.when(F.col("price") < 1100, "low").otherwise("high")), "regime")


@query("n_train bigint, n_val bigint, n_test bigint, overlapping bigint", f"WITH {ROLES} SELECT count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'val') AS n_val, count(*) FILTER (WHERE role = 'test') AS n_test, 0 AS overlapping FROM sp")
def split_guard(spark, sf):
    return splits.check_split(splits.split_by_predicate(parts(spark, sf), ["g"], F.col("size") > 35, 0.6, 3), ["g"])


@query("g bigint, stratum string", f"WITH {PARTS}, z AS (SELECT stratum, count(*) AS size, count(*) OVER () AS k FROM p GROUP BY stratum), w AS (SELECT *, least(size, floor(60 / k) + (row_number() OVER (ORDER BY size DESC, stratum) <= 60 % k)::INT) AS wanted FROM z), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', g, 2)), g) AS rn FROM p) SELECT o.g, o.stratum FROM o JOIN w ON o.stratum = w.stratum WHERE rn <= wanted")
def sample_stratified(spark, sf):
    return splits.sample_stratified(parts(spark, sf), ["g"], "stratum", 60, 2)


@query("g bigint, stratum string", f"WITH {PARTS}, z AS (SELECT stratum, count(*) AS size, count(*) OVER () AS k FROM p GROUP BY stratum), y AS (SELECT *, floor(size / sum(size) OVER () * (60 - k)) AS part FROM z), x AS (SELECT *, 60 - k - sum(part) OVER () AS rest, row_number() OVER (ORDER BY stratum) - 1 AS turn FROM y), w AS (SELECT *, least(size, 1 + part + floor(rest / k) + (turn < rest % k)::INT) AS wanted FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', g, 2)), g) AS rn FROM p) SELECT o.g, o.stratum FROM o JOIN w ON o.stratum = w.stratum WHERE rn <= wanted")
def sample_proportional(spark, sf):
    return splits.sample_stratified(parts(spark, sf), ["g"], "stratum", 60, 2, proportional=True)


def _spread_sql(n: int) -> str:
    """The targets one after the other, each taking the nearest group that is left."""
    out = f"{PARTS}"
    for i in range(n):
        gone = " UNION ALL ".join(f"SELECT g FROM k{j}" for j in range(i)) or "SELECT NULL::BIGINT WHERE false"
        out += f", k{i} AS (SELECT g, price FROM p, (SELECT quantile_cont(price, {(i + 0.5) / n!r}) AS target FROM p) WHERE g NOT IN ({gone}) ORDER BY abs(price - target), price, g LIMIT 1)"
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT g, price FROM k{i}" for i in range(n))


@query("g bigint, price double", _spread_sql(12))
def sample_spread(spark, sf):
    return splits.sample_spread(parts(spark, sf), "g", "price", 12)


def ratios(spark, sf):
    return parts(spark, sf).withColumn("ratio", F.round(F.col("price") / 1400, 9))


@query("g bigint, ratio double", f"WITH {PARTS} SELECT g, round(price / 1400, 9) AS ratio FROM p ORDER BY abs(round(price / 1400, 9) - 1), g LIMIT 12")
def sample_boundary(spark, sf):
    return splits.sample_boundary(ratios(spark, sf), "g", "ratio", 12)


@query("g bigint, price double, arm string", _spread_sql(12).replace("WITH ", "WITH sp AS (WITH ", 1) + "), bd AS (SELECT p_partkey AS g, p_retailprice AS price FROM part ORDER BY abs(round(p_retailprice / 1400, 9) - 1), p_partkey LIMIT 6), lf AS (SELECT *, row_number() OVER (ORDER BY price, g) AS rn FROM sp WHERE g NOT IN (SELECT g FROM bd)) SELECT g, price, 'boundary' AS arm FROM bd UNION ALL SELECT g, price, 'spread' FROM lf WHERE rn <= 6")
def sample_mixed(spark, sf):
    """Half of the sample at the boundary, the other half spread over the prices."""
    return splits.sample_mixed(ratios(spark, sf), "g", "ratio", "price", 12)


@query("g bigint, stratum string, turn bigint", f"WITH {PARTS}, i AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY g) AS turn FROM p), o AS (SELECT *, row_number() OVER (ORDER BY turn, stratum, g) AS pl FROM i) SELECT g, stratum, turn FROM o WHERE turn = 1 OR pl <= 70")
def spread_groups(spark, sf):
    return splits.spread_groups(parts(spark, sf), ["g"], "stratum", 70)


@query("g bigint, half string", f"WITH {PARTS}, o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', g, 5)), g) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM p) SELECT g, CASE WHEN rn <= n // 2 + (n % 2 = 1 AND ('0x' || substr(md5('coin|' || stratum || '|5'), 1, 8))::UBIGINT / 4294967296.0 < 0.5)::INT THEN 'a' ELSE 'b' END AS half FROM o")
def halve(spark, sf):
    return splits.halve(parts(spark, sf), ["g"], 5, "stratum")


RULES = f"{EV}, {evaluate_sql('s2', name='eb')}, {evaluate_sql('f0', name='ec')}, rules AS (SELECT 'a' AS rule, g, regret FROM ev WHERE k = 1 UNION ALL SELECT 'b', g, regret FROM eb WHERE k = 1 UNION ALL SELECT 'c', g, regret FROM ec WHERE k = 1)"


def rule_evaluations(spark, sf):
    mt = part(spark, sf)
    return cross.merge_shards([evaluate(mt, s, (1,)).withColumn("rule", F.lit(r)) for r, s in (("a", "s"), ("b", "s2"), ("c", "f0"))], ["rule"])


@query("halving bigint, rule string, chosen_on double, read_on double, oracle double, loss double", f"WITH {RULES}, hv AS (SELECT g, halving, row_number() OVER (PARTITION BY halving ORDER BY md5(concat_ws('|', g, halving)), g) % 2 = 1 AS a FROM (SELECT DISTINCT g FROM rules), (SELECT unnest(range(0, 10)) AS halving)), q AS (SELECT halving, rule, exp(avg(ln(regret)) FILTER (WHERE a)) AS ra, exp(avg(ln(regret)) FILTER (WHERE NOT a)) AS rb FROM rules JOIN hv ON rules.g = hv.g GROUP BY halving, rule), o AS (SELECT *, row_number() OVER (PARTITION BY halving ORDER BY ra, rule) AS rn, min(rb) OVER (PARTITION BY halving) AS best FROM q) SELECT halving, rule, ra AS chosen_on, rb AS read_on, best AS oracle, rb - best AS loss FROM o WHERE rn = 1")
def honest_selection(spark, sf):
    return splits.honest_selection(rule_evaluations(spark, sf), ["g"], 10)


@query("rule string, val_rank bigint, val double, best_val double, gap double", f"WITH {RULES}, q AS (SELECT rule, exp(avg(ln(regret)) FILTER (WHERE p_size <= 35)) AS train, exp(avg(ln(regret)) FILTER (WHERE p_size > 35)) AS val FROM rules JOIN part ON g = p_partkey GROUP BY rule), o AS (SELECT *, rank() OVER (ORDER BY val) AS vr, row_number() OVER (ORDER BY train, rule) AS rn, min(val) OVER () AS best FROM q) SELECT rule, vr AS val_rank, val, best AS best_val, val - best AS gap FROM o WHERE rn = 1")
def selection_overfit(spark, sf):
    return splits.selection_overfit(rule_evaluations(spark, sf).join(parts(spark, sf), "g").withColumn("role", F.when(F.col("size") > 35, "val").otherwise("train")))


@query("rule string, k bigint, g bigint, regret double", f"WITH {RULES} SELECT rule, 1 AS k, g, regret FROM rules")
def merge_shards(spark, sf):
    return rule_evaluations(spark, sf)


@query("g bigint", f"WITH {A_SQL}, {B_SQL} SELECT DISTINCT g FROM a WHERE g IN (SELECT g FROM b)")
def common_groups(spark, sf):
    return cross.common_groups(part_by_status(spark, sf, "F"), part_by_status(spark, sf, "O"))


@query("g bigint, i1 bigint", f"WITH {A_SQL}, {B_SQL} SELECT g, i1 FROM a INTERSECT SELECT g, i1 FROM b")
def common_axis_keys(spark, sf):
    return cross.common_axes(part_by_status(spark, sf, "F"), part_by_status(spark, sf, "O"), ("i1",))


@query("both bigint, only_a bigint, only_b bigint, groups_both bigint, groups_a bigint, groups_b bigint", f"WITH {A_SQL}, {B_SQL}, f AS (SELECT coalesce(a.g, b.g) AS g, a.g IS NOT NULL AS x, b.g IS NOT NULL AS y FROM a FULL JOIN b ON a.g = b.g AND a.i1 = b.i1 AND a.i2 = b.i2 AND a.i3 = b.i3), p AS (SELECT g, bool_or(x) AS x, bool_or(y) AS y FROM f GROUP BY g) SELECT (SELECT count(*) FROM f WHERE x AND y) AS both, (SELECT count(*) FROM f WHERE x AND NOT y) AS only_a, (SELECT count(*) FROM f WHERE NOT x AND y) AS only_b, count(*) FILTER (WHERE x AND y) AS groups_both, count(*) FILTER (WHERE x AND NOT y) AS groups_a, count(*) FILTER (WHERE y AND NOT x) AS groups_b FROM p")
def cross_report(spark, sf):
    return cross.cross_report(part_by_status(spark, sf, "F"), part_by_status(spark, sf, "O"))


@query("g bigint, regime_a string, regime_b string", f"WITH {PART_SQL}, x AS (SELECT g, round(avg(f0), 9) AS v FROM m GROUP BY g) SELECT g, CASE WHEN v / 0.48 < 1 THEN 'mem' ELSE 'comp' END AS regime_a, CASE WHEN v / 0.54 < 1 THEN 'mem' ELSE 'comp' END AS regime_b FROM x WHERE (v / 0.48 < 1) <> (v / 0.54 < 1)")
def bound_flips(spark, sf):
    return cross.bound_flips(part(spark, sf).rows.groupBy("g").agg(F.round(F.avg("f0"), 9).alias("v")), "v", 0.48, 0.54)


TRANSFER = f"{A_SQL}, {B_SQL}, ba AS (SELECT g, min(t) AS best FROM a WHERE t > 0 GROUP BY g), kn AS (SELECT i1, {GEO.format('(t / best)')} AS v FROM a JOIN ba ON a.g = ba.g GROUP BY i1), tb AS (SELECT b.*, round(coalesce(v, 1e9), 9) AS transfer FROM b LEFT JOIN kn ON b.i1 = kn.i1)"


@query("g bigint, picked double, best double", f"WITH {TRANSFER}, o AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY transfer, i1, i2, i3) AS rn, min(t) FILTER (WHERE t > 0) OVER (PARTITION BY g) AS best FROM tb) SELECT g, t AS picked, best FROM o WHERE rn = 1")
def axis_transfer_order(spark, sf):
    mt = cross.transfer_order(part_by_status(spark, sf, "F"), part_by_status(spark, sf, "O"), ("i1",))
    return mt.rows.groupBy("g").agg(F.min_by("t", F.struct("transfer", *mt.ids)).alias("picked"), C.best_of(F.col("t")).alias("best"))


WANTED = "wanted AS (SELECT p_partkey AS g, p_partkey % 100 AS i1, 1 + p_size % 7 AS i2 FROM part)"


def wanted(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("g"), (F.col("p_partkey") % 100).alias("i1"), (1 + F.col("p_size") % 7).cast("long").alias("i2"))


@query("g bigint, found boolean, matched double", f"WITH {PART_SQL}, {WANTED}, x AS (SELECT g, i1, i2, min(t) AS matched FROM m GROUP BY g, i1, i2) SELECT w.g, matched IS NOT NULL AS found, matched FROM wanted w LEFT JOIN x ON w.g = x.g AND w.i1 = x.i1 AND w.i2 = x.i2")
def recommend_exact(spark, sf):
    return cross.match_exact(wanted(spark, sf), part(spark, sf), ("i1", "i2"))


NEAREST = f"{WANTED}, dist AS (SELECT m.*, round(pow(log2(greatest(m.i1, 1) + 1) - log2(greatest(w.i1, 1) + 1), 2) + 4 * pow(log2(greatest(m.i2, 1) + 1) - log2(greatest(w.i2, 1) + 1), 2), 9) AS distance FROM m JOIN wanted w ON m.g = w.g), nr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY distance, i1, i2, i3) AS rn FROM dist)"


@query("g bigint, distance double, i1 bigint, i2 bigint, i3 string, picked double", f"WITH {PART_SQL}, {NEAREST} SELECT g, distance, i1, i2, i3, t AS picked FROM nr WHERE rn = 1")
def recommend_nearest(spark, sf):
    return cross.match_nearest(wanted(spark, sf), part(spark, sf), ("i1", "i2"), (1.0, 4.0))


WISHES = "wishes AS (SELECT p_partkey AS g, w AS wish, (p_partkey + 37 * w) % 100 AS a1, 1 + (p_size + w // 2) % 7 AS a2 FROM part, (SELECT unnest(range(0, 4)) AS w)), wd AS (SELECT m.g, wish, i1, i2, i3, i1 = a1 AND i2 = a2 AS exact, round(pow(log2(greatest(i1, 1) + 1) - log2(greatest(a1, 1) + 1), 2) + 4 * pow(log2(greatest(i2, 1) + 1) - log2(greatest(a2, 1) + 1), 2), 9) AS apart FROM m JOIN wishes ON m.g = wishes.g)"


def _order_sql(name: str, condition: str = "true") -> str:
    """The candidates in the recommended order, as CTEs."""
    return f"""{name}p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, wish ORDER BY CASE WHEN exact THEN -1 ELSE apart END, i1, i2, i3) AS rn FROM wd WHERE {condition}) WHERE rn = 1), {name}f AS (SELECT g, i1, i2, i3, min(wish) AS wish FROM {name}p GROUP BY g, i1, i2, i3),
      {name} AS (SELECT m.*, f.wish, row_number() OVER (PARTITION BY m.g ORDER BY coalesce(f.wish, 1099511627776), m.i1, m.i2, m.i3) AS place FROM m LEFT JOIN {name}f f ON m.g = f.g AND m.i1 = f.i1 AND m.i2 = f.i2 AND m.i3 = f.i3)"""


def wishes(spark, sf):
    """Four wanted vectors for each part, in order."""
    w = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("wish")
    asked = read(spark, sf, "part").select("p_partkey", "p_size", w)
    return asked.select(F.col("p_partkey").alias("g"), "wish", ((F.col("p_partkey") + 37 * F.col("wish")) % 100).alias("i1"), (1 + (F.col("p_size") + F.floor(F.col("wish") / 2)) % 7).cast("long").alias("i2"))


def _first_places(mt):
    top = mt.ranked("wish", "place").where(F.col("place") <= 6)
    return top.select("g", "place", *mt.ids, (F.col("wish") < 4).alias("wished"))


@query("g bigint, place bigint, i1 bigint, i2 bigint, i3 string, wished boolean", f"WITH {PART_SQL}, {WISHES}, {_order_sql('od')} SELECT g, place, i1, i2, i3, wish IS NOT NULL AS wished FROM od WHERE place <= 6")
def recommend_order(spark, sf):
    """The first six candidates of each part in the order of four wishes, each the candidate at it or else the nearest."""
    return _first_places(cross.recommended(wishes(spark, sf), part(spark, sf), ("i1", "i2"), (1.0, 4.0)))


@query("g bigint, place bigint, i1 bigint, i2 bigint, i3 string, wished boolean", f"WITH {PART_SQL}, {WISHES}, {_order_sql('od', 'exact')} SELECT g, place, i1, i2, i3, wish IS NOT NULL AS wished FROM od WHERE place <= 6")
def recommend_strict(spark, sf):
    """The same with exact matches only."""
    return _first_places(cross.recommended(wishes(spark, sf), part(spark, sf), ("i1", "i2"), (1.0, 4.0), nearest=False))


PAIRS = """o AS (SELECT m.*, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS rn FROM m),
 pr AS (SELECT a.g, a.rn AS rn_a, b.rn AS rn_b, a.t AS t_a, b.t AS t_b, (b.t - a.t) / st.best AS weight, a.f0 - b.f0 AS d0, a.f1 - b.f1 AS d1 FROM o a JOIN o b ON a.g = b.g AND a.rn < b.rn AND b.rn <= {n} JOIN st ON st.g = a.g
   WHERE abs(a.t - b.t) > 2 * sqrt((greatest(0.05 / a.t + 0.002, 0.1 / a.t) * a.t) ** 2 + (greatest(0.05 / b.t + 0.002, 0.1 / b.t) * b.t) ** 2))"""


@query("g bigint, rn_a bigint, rn_b bigint, t_a double, t_b double, weight double", f"WITH {ST}, {PAIRS.format(n=6)} SELECT g, rn_a, rn_b, t_a, t_b, weight FROM pr")
def pair_join(spark, sf):
    return cross.pairs(part(spark, sf), 6)


@query("g bigint, rn_a bigint, rn_b bigint, t_a double, t_b double", f"WITH {PART_SQL}, o AS (SELECT m.*, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS rn, count(*) OVER (PARTITION BY g) AS n FROM m), ng AS (SELECT DISTINCT o.g, o.rn, o.t FROM o, (SELECT unnest(range(0, 4)) AS j) WHERE rn > 2 AND rn = 3 + floor(j * ((n - 2 - 1) / 3.0) + 1e-9)) SELECT a.g, a.rn AS rn_a, b.rn AS rn_b, a.t AS t_a, b.t AS t_b FROM o a JOIN ng b ON a.g = b.g AND a.rn <= 2")
def contrast_pairs(spark, sf):
    return cross.contrast_pairs(part(spark, sf), 2, 4)


@query("split_a string, split_b string, n bigint", f"WITH {PARTS}, sa AS (SELECT 'size' AS split, g, size > 35 AS held FROM p), sb AS (SELECT 'price' AS split, g, price > 1500 AS held FROM p) SELECT sa.split AS split_a, sb.split AS split_b, count(*) AS n FROM sa JOIN sb ON sa.g = sb.g WHERE sa.held AND NOT sb.held GROUP BY 1, 2")
def split_contact(spark, sf):
    p = parts(spark, sf)
    a, b = (splits.split_by_predicate(p, ["g"], F.col(c) > v).withColumn("split", F.lit(c)) for c, v in (("size", 35), ("price", 1500)))
    return cross.contact(a, b, ["g"])


@query("g bigint, old double, new double, changed boolean", f"WITH {A_SQL}, {PART_SQL}, x AS (SELECT g, min(t) AS v FROM a GROUP BY g), y AS (SELECT g, min(t) AS v FROM m GROUP BY g) SELECT coalesce(x.g, y.g) AS g, x.v AS old, y.v AS new, x.v IS DISTINCT FROM y.v AS changed FROM x FULL JOIN y ON x.g = y.g")
def table_diff(spark, sf):
    old, new = (mt.rows.groupBy("g").agg(F.min("t").alias("v")) for mt in (part_by_status(spark, sf, "F"), part(spark, sf)))
    return cross.diff_tables(old, new, ["g"], "v")


@query("block bigint, n bigint, mean double, median double, same double", "WITH s AS (SELECT c_nationkey AS block, c_custkey AS k, list_distinct(list(o_orderpriority)) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), j AS (SELECT a.block, len(list_intersect(a.x, b.x)) AS i, len(a.x) AS na, len(b.x) AS nb FROM s a JOIN s b ON a.block = b.block AND a.k < b.k), v AS (SELECT block, i / (na + nb - i) AS j FROM j) SELECT block, count(*) AS n, avg(j) AS mean, median(j) AS median, avg((j = 1)::INT) AS same FROM v GROUP BY block")
def jaccard_overlap(spark, sf):
    """The customers' sets of order priorities, by nation."""
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    sets = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("block"), "c_custkey").agg(F.collect_set("o_orderpriority").alias("x"))
    return cross.jaccard_pairs(sets, "block", "x")


FLOOR_SQL = """sz AS (SELECT st.g AS id, least(count(*) FILTER (WHERE t <= best * (1 + tol)), 20) AS a, least(any_value(st.n), 20) AS b FROM m JOIN st ON m.g = st.g GROUP BY st.g),
 dr AS (SELECT id, draw, s, i, row_number() OVER (PARTITION BY id, draw, s ORDER BY md5(concat_ws('|', s, id, draw, i)), i) AS rn, CASE s WHEN 'a' THEN a ELSE b END AS want FROM sz, (SELECT unnest(range(0, 5)) AS draw), (SELECT unnest(['a', 'b']) AS s), (SELECT unnest(range(1, 41)) AS i)),
 tk AS (SELECT id, draw, i, bool_or(s = 'a') AS x, bool_or(s = 'b') AS y FROM dr WHERE rn <= want GROUP BY id, draw, i)"""


@query("id bigint, mean double, draws bigint", f"WITH {ST}, {FLOOR_SQL}, j AS (SELECT id, draw, count(*) FILTER (WHERE x AND y) / count(*) AS j FROM tk GROUP BY id, draw) SELECT id, avg(j) AS mean, count(*) AS draws FROM j GROUP BY id")
def jaccard_floor(spark, sf):
    sizes = group_stats(part(spark, sf)).select(F.col("g").alias("id"), F.least("n_answers", F.lit(20)).alias("size_a"), F.least("n", F.lit(20)).alias("size_b"))
    return cross.jaccard_floor(sizes, 40, 5)


@query("arm string, n bigint, mean double, better bigint, worse bigint", "WITH x AS (SELECT user_id, ts::DATE AS d, min(value) FILTER (WHERE event_type = 'click') AS a, min(value) FILTER (WHERE event_type = 'view') AS b FROM events WHERE value > 0 GROUP BY 1, 2) SELECT 'click' AS arm, count(*) AS n, avg(ln(a / b)) AS mean, count(*) FILTER (WHERE a < b) AS better, count(*) FILTER (WHERE a > b) AS worse FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_arms(spark, sf):
    events = read(spark, sf, "events").where("value > 0").select("user_id", F.to_date("ts").alias("d"), "event_type", "value")
    return cross.paired_log_diff(events, "event_type", "click", "view", ["user_id", "d"], "value").withColumn("arm", F.lit("click"))


