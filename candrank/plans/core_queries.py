"""Queries on loading, noise, statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators import compare as cmp
from candrank.operators import rank
from candrank.plans.fixtures import BRAND_SQL, FLOOR, NOISE, PART_SQL, brand, evaluate_sql, part, part_by_status, part_sql, read, stats_sql
from candrank.plans.registry import query
from candrank.sources import bundle
from candrank.table import evaluate as evaluate_
from candrank.table import group_stats as stats_

ST = f"{PART_SQL}, {stats_sql()}"
EV = f"{ST}, {evaluate_sql()}"
BST = f"{BRAND_SQL}, {stats_sql(0.95)}"
BEV = f"{BST}, {evaluate_sql(ids='i1, i2, i3, i4')}"
GEO = "exp(avg(ln({0})) FILTER (WHERE isfinite({0}) AND {0} > 0))"
FL_T = FLOOR.format("t")


@query("g bigint, i1 bigint, t double", "SELECT l_partkey AS g, l_suppkey AS i1, l_extendedprice / 1000 AS t FROM lineitem WHERE l_linestatus = 'F'")
def load_measurements(spark, sf):
    lines = read(spark, sf, "lineitem").withColumnsRenamed({"l_partkey": "g", "l_suppkey": "i1", "l_linestatus": "status"}).withColumn("t", F.col("l_extendedprice") / 1000)
    meta = lines.select(F.lit("abc123").alias("env_hash")).limit(1)
    return bundle.load_measurements(lines, meta, "abc", ok_only=True, ok="F")


@query("g bigint, kernel string, extra double, mode string", "SELECT l_partkey AS g, l_returnflag AS kernel, coalesce(l_discount, 0) + coalesce(l_tax, 0) AS extra, 'serial' AS mode FROM lineitem")
def normalize_schema(spark, sf):
    return bundle.normalize(read(spark, sf, "lineitem"), aliases={"g": ("part", "l_partkey"), "kernel": ("l_returnflag",)}, sums={"extra": ("l_discount", "l_tax")}, defaults={"mode": "serial"}, required=("g", "kernel"))


@query("n_features bigint, n_costs bigint, one_sided bigint", f"WITH {PART_SQL} SELECT count(*) AS n_features, count(t) AS n_costs, 0 AS one_sided FROM m")
def split_answers(spark, sf):
    mt = part(spark, sf)
    features, costs = bundle.split_answers(mt)
    return bundle.check_keys(features, costs, [*mt.groups, *mt.ids])


@query("name string, value string", "SELECT 'env' AS name, 'x1' AS value UNION ALL SELECT 'tick', '0.1'")
def lift_constants(spark, sf):
    lines = read(spark, sf, "lineitem").withColumns({"env": F.lit("x1"), "tick": F.lit("0.1")})
    return bundle.lift_constants(lines, ("env", "tick", "l_returnflag"))[1]


SUMMARY = "g bigint, n bigint, best double, median double, difficulty double, floor double, tol double, n_answers bigint, n_ties bigint, n_distinct bigint, distinct_fraction double, small boolean"
SUMMARY_SQL = f"WITH {ST} SELECT st.g, any_value(n) AS n, any_value(best) AS best, any_value(median) AS median, any_value(difficulty) AS difficulty, any_value(floor) AS floor, any_value(tol) AS tol, count(*) FILTER (WHERE t <= best * (1 + tol)) AS n_answers, count(*) FILTER (WHERE t = best) AS n_ties, any_value(n_distinct) AS n_distinct, any_value(n_distinct / n) AS distinct_fraction, any_value(small) AS small FROM st JOIN m ON st.g = m.g GROUP BY st.g"


@query(SUMMARY, SUMMARY_SQL)
def group_stats(spark, sf):
    return stats_(part(spark, sf))


@query("g bigint, n bigint, best double, difficulty double, small boolean", f"WITH {ST} SELECT g, n, best, difficulty, small FROM st")
def summary_table(spark, sf):
    return stats_(part(spark, sf)).select("g", "n", "best", "difficulty", "small")


@query("g bigint, i1 bigint, i2 bigint, i3 string, name string, value double", f"WITH {PART_SQL} SELECT g, i1, i2, i3, 'f0' AS name, f0 AS value FROM m UNION ALL SELECT g, i1, i2, i3, 'f1', f1 FROM m")
def long_export(spark, sf):
    return bundle.to_long(part(spark, sf).rows, ["g", "i1", "i2", "i3"], ["f0", "f1"])


@query("g bigint, i1 bigint, i2 bigint, i3 string, f0 double, f1 double", f"WITH {PART_SQL} SELECT g, i1, i2, i3, f0, f1 FROM m")
def feature_matrix_sink(spark, sf):
    mt = part(spark, sf)
    return bundle.materialize(mt, {"f0": F.col("f0"), "f1": F.col("f1")})


NOISE_SQL = f"WITH {PART_SQL} SELECT g, i1, i2, i3, t, {{0}} AS value FROM m"
KEYED = "g bigint, i1 bigint, i2 bigint, i3 string, t double, value double"


@query(KEYED, NOISE_SQL.format("CASE WHEN t > 0 THEN 0.05 / t + 0.002 ELSE 0.002 END"))
def noise_sigma(spark, sf):
    return part(spark, sf).rows.withColumn("value", C.sigma(F.col("t"), NOISE))


@query(KEYED, NOISE_SQL.format("CASE WHEN t > 0 THEN 0.1 / t ELSE 'inf'::DOUBLE END"))
def noise_tick_pct(spark, sf):
    return part(spark, sf).rows.withColumn("value", C.tick_share(F.col("t"), NOISE))


@query(KEYED, NOISE_SQL.format(FL_T))
def noise_floor(spark, sf):
    return part(spark, sf).rows.withColumn("value", C.floor(F.col("t"), NOISE))


@query("g bigint, n bigint, n_resolved bigint", f"WITH {ST} SELECT m.g, count(*) AS n, count(*) FILTER (WHERE abs(t - best) > 2 * sqrt(({FL_T} * t) ** 2 + (floor * best) ** 2)) AS n_resolved FROM m JOIN st ON m.g = st.g GROUP BY m.g")
def resolvable(spark, sf):
    mt = part(spark, sf)
    return mt.with_best().groupBy("g").agg(F.count("*").alias("n"), F.count_if(C.resolvable(F.col("t"), F.col("best"), NOISE)).alias("n_resolved"))


@query("g string, i1 bigint, i2 bigint, i3 bigint, i4 bigint, t double", f"WITH {BST} SELECT m.g, i1, i2, i3, i4, t FROM m JOIN st ON m.g = st.g WHERE t <= best * (1 + tol)")
def answer_mask(spark, sf):
    return rank.answers(brand(spark, sf))


@query("kept bigint, n bigint, share double", f"WITH {PART_SQL} SELECT count(*) FILTER (WHERE f0 <= 0.9 AND f1 > 0.01) AS kept, count(*) AS n, count(*) FILTER (WHERE f0 <= 0.9 AND f1 > 0.01) / count(*) AS share FROM m")
def prune_mask(spark, sf):
    return rank.prune_share(part(spark, sf), (F.col("f0") <= 0.9) & (F.col("f1") > 0.01))


@query("g bigint, n_families bigint", f"WITH {PART_SQL} SELECT g, count(DISTINCT i3) AS n_families FROM m GROUP BY g HAVING count(DISTINCT i3) >= 2")
def population_by_family(spark, sf):
    return rank.population(part(spark, sf), "i3", 2)


@query("g bigint, n bigint", f"WITH {PART_SQL} SELECT g, count(*) AS n FROM m GROUP BY g HAVING bool_and(f1 <= 0.1 AND i2 < 8)")
def population_by_all(spark, sf):
    return rank.population_all(part(spark, sf), (F.col("f1") <= 0.1) & (F.col("i2") < 8))


@query("g bigint, ratio double, regime string", f"WITH {PART_SQL} SELECT g, round(avg(f0), 9) / 0.51 AS ratio, CASE WHEN round(avg(f0), 9) / 0.51 < 1 THEN 'mem' ELSE 'comp' END AS regime FROM m GROUP BY g")
def regime_label(spark, sf):
    return rank.regimes(part(spark, sf).rows.groupBy("g").agg(F.round(F.avg("f0"), 9).alias("x")), F.col("x"), 0.51)


@query("g bigint, class string", f"WITH {PART_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS rn FROM m) SELECT g, CASE WHEN f1 >= 0.08 THEN 'hungry' WHEN t < 2 THEN 'small' WHEN t > 6 THEN 'big' ELSE 'mid' END AS class FROM o WHERE rn = 1")
def shape_classes(spark, sf):
    return rank.classify(part(spark, sf), [("hungry", F.col("f1") >= 0.08), ("small", F.col("t") < 2), ("big", F.col("t") > 6)], "mid")


@query("g bigint, best double, band bigint", f"WITH {ST}, e AS (SELECT quantile_cont(best, 1 / 3.0) AS a, quantile_cont(best, 2 / 3.0) AS b FROM st) SELECT g, best, (best > a)::INT + (best > b)::INT AS band FROM st, e")
def m_bands(spark, sf):
    return rank.tertile_band(stats_(part(spark, sf)).select("g", "best"), "best")


@query("same bigint, n bigint", f"WITH {PART_SQL} SELECT count(*) FILTER (WHERE abs(s - s2) <= 0.05 * greatest(1.0, abs(s), abs(s2))) AS same, count(*) AS n FROM m")
def approx_compare(spark, sf):
    return part(spark, sf).rows.agg(F.count_if(C.approx_equal(F.col("s"), F.col("s2"), 0.05)).alias("same"), F.count("*").alias("n"))


@query("g bigint, n bigint, n_bad bigint, permutation boolean", f"WITH {PART_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, i1, i2, i3) - 1 AS pos FROM m) SELECT g, count(*) AS n, count(*) FILTER (WHERE s IS NULL OR NOT isfinite(s)) AS n_bad, count(DISTINCT pos) = count(*) AND min(pos) = 0 AND max(pos) = count(*) - 1 AS permutation FROM o GROUP BY g")
def validity_check(spark, sf):
    mt = part(spark, sf)
    return rank.validity(mt.of(mt.ranked("s", "pos").withColumn("pos", F.col("pos") - 1)), "s", "pos")


@query("geo double, n bigint", f"WITH {EV} SELECT {GEO.format('regret')} AS geo, count(*) AS n FROM ev WHERE k = 1")
def geomean(spark, sf):
    return evaluate_(part(spark, sf), "s").where("k = 1").agg(C.geomean(F.col("regret")).alias("geo"), F.count("*").alias("n"))


@query("g bigint, k bigint, regret double, hit boolean, tol double", f"WITH {EV} SELECT g, k, regret, hit, tol FROM ev")
def evaluate(spark, sf):
    return evaluate_(part(spark, sf), "s")


def _strata_sql(ev: str) -> str:
    parts = {"all": "true", "large": "NOT small", "small": "small", "hard": "hard", "easy": "NOT hard"}
    cols = ", ".join(f"exp(avg(ln(regret)) FILTER (WHERE {c} AND regret > 0)) AS regret_{n}" for n, c in parts.items())
    return f"WITH {ev}, hard AS (SELECT g, small, difficulty > (SELECT median(difficulty) FROM st) AS hard FROM st) SELECT k, {cols}, count(*) FILTER (WHERE small) AS n_small, count(*) AS n_groups, avg(hit::INT) AS hit_rate, regret_small - regret_large AS size_gap, regret_hard - regret_easy AS difficulty_gap FROM ev JOIN hard ON ev.g = hard.g GROUP BY k"


STRATA = "k bigint, regret_all double, regret_large double, regret_small double, regret_hard double, regret_easy double, n_small bigint, n_groups bigint, hit_rate double, size_gap double, difficulty_gap double"


@query(STRATA, _strata_sql(EV))
def stratified(spark, sf):
    mt = part(spark, sf)
    return cmp.stratified(evaluate_(mt, "s"), stats_(mt), ("g",))


@query(STRATA, _strata_sql(BEV))
def stratified_large_groups(spark, sf):
    mt = brand(spark, sf)
    return cmp.stratified(evaluate_(mt, "s"), stats_(mt), ("g",))


CMP = f"{EV}, {evaluate_sql('s2', name='eb')}, d AS (SELECT ev.g, ev.regret AS ra, eb.regret AS rb, ev.regret - eb.regret AS delta, (ev.regret - eb.regret) / st.floor AS sigma FROM ev JOIN eb ON ev.g = eb.g AND ev.k = 1 AND eb.k = 1 JOIN st ON st.g = ev.g)"


@query(
    "geo_a double, geo_b double, wins bigint, losses bigint, ties bigint, best_gain double, worst_loss double, n_large_loss bigint, gain_group bigint, loss_group bigint",
    f"WITH {CMP} SELECT {GEO.format('ra')} AS geo_a, {GEO.format('rb')} AS geo_b, count(*) FILTER (WHERE sigma < -2) AS wins, count(*) FILTER (WHERE sigma > 2) AS losses, count(*) FILTER (WHERE abs(sigma) <= 2) AS ties, min(delta) AS best_gain, max(delta) AS worst_loss, count(*) FILTER (WHERE delta > 0.05) AS n_large_loss, (SELECT g FROM d ORDER BY delta, g LIMIT 1) AS gain_group, (SELECT g FROM d ORDER BY delta DESC, g LIMIT 1) AS loss_group FROM d",
)
def compare(spark, sf):
    mt = part(spark, sf)
    return cmp.compare(evaluate_(mt, "s"), evaluate_(mt, "s2"), stats_(mt), ("g",))


@query("delta double, threshold double, significant boolean", f"WITH {CMP} SELECT {GEO.format('ra')} - {GEO.format('rb')} AS delta, (SELECT {GEO.format('tol')} FROM st) AS threshold, abs({GEO.format('ra')} - {GEO.format('rb')}) > (SELECT {GEO.format('tol')} FROM st) AS significant FROM d")
def is_significant(spark, sf):
    mt = part(spark, sf)
    return cmp.significant(evaluate_(mt, "s").where("k = 1"), evaluate_(mt, "s2").where("k = 1"), ("g",))


@query(
    "wins bigint, losses bigint, ties bigint, p double",
    f"WITH {BEV}, er AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY f1, i1, i2, i3, i4) AS rn FROM m), eb AS (SELECT er.g, t / best AS regret FROM er JOIN st ON er.g = st.g WHERE rn = 1), c AS (SELECT count(*) FILTER (WHERE ev.regret < eb.regret - 1e-9) AS wins, count(*) FILTER (WHERE ev.regret > eb.regret + 1e-9) AS losses, count(*) FILTER (WHERE abs(ev.regret - eb.regret) <= 1e-9) AS ties FROM ev JOIN eb ON ev.g = eb.g AND ev.k = 1) SELECT wins, losses, ties, least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(0, 60) x(i) WHERE i <= least(wins, losses))) AS p FROM c",
)
def sign_test(spark, sf):
    mt = brand(spark, sf)
    return cmp.sign_test(evaluate_(mt, "s", (1,)), evaluate_(mt, "f1", (1,)), ("g", "k"))


@query("g bigint, i1 bigint, i2 bigint, i3 string, tb bigint", f"WITH {PART_SQL} SELECT g, i1, i2, i3, row_number() OVER (PARTITION BY g ORDER BY i1, i2, i3) - 1 AS tb FROM m")
def tiebreak_rank(spark, sf):
    return rank.tiebreak(part(spark, sf))


@query("g bigint, i1 bigint, i2 bigint, i3 string, rn bigint", f"WITH {PART_SQL} SELECT g, i1, i2, i3, row_number() OVER (PARTITION BY g ORDER BY s, i1, i2, i3) AS rn FROM m")
def order_candidates(spark, sf):
    return part(spark, sf).ranked("s")


@query("g bigint, i1 bigint, i2 bigint, i3 string, rn bigint", f"WITH {PART_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, i1, i2, i3) AS rn FROM m) SELECT g, i1, i2, i3, rn FROM o WHERE rn <= 5")
def top_k(spark, sf):
    return rank.top_k(part(spark, sf), "s", 5)


@query("g bigint, k bigint, regret double", f"WITH {PART_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, i1, i2, i3) AS a, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS b FROM m) SELECT g, k, avg(t) FILTER (WHERE a <= k) / avg(t) FILTER (WHERE b <= k) AS regret FROM o, (SELECT unnest([1, 3, 5]) AS k) GROUP BY g, k")
def regret_at_k_mean(spark, sf):
    return rank.regret_mean_at_k(part(spark, sf), "s", (1, 3, 5))


@query("pct bigint, hit_best double, hit_answer double", f"WITH {BST}, o AS (SELECT m.*, best, tol, n, row_number() OVER (PARTITION BY m.g ORDER BY s, i1, i2, i3, i4) AS rn FROM m JOIN st ON m.g = st.g), h AS (SELECT g, pct, bool_or(t = best AND rn <= greatest(1, ceil(n * pct / 100.0))) AS b, bool_or(t <= best * (1 + tol) AND rn <= greatest(1, ceil(n * pct / 100.0))) AS a FROM o, (SELECT unnest([1, 5, 20]) AS pct) GROUP BY g, pct) SELECT pct, avg(b::INT) AS hit_best, avg(a::INT) AS hit_answer FROM h GROUP BY pct")
def hit_at_pct(spark, sf):
    return rank.hit_at_pct(brand(spark, sf), "s", (1, 5, 20))


TAU = """top AS (SELECT * FROM (SELECT g, s, t, row_number() OVER (PARTITION BY g ORDER BY t, {ids}) AS rn FROM m) WHERE rn <= {n}),
 pr AS (SELECT a.g, count(*) AS pairs, sum(sign(a.s - b.s) * sign(a.t - b.t)) AS c, count(*) FILTER (WHERE a.s = b.s) AS ts, count(*) FILTER (WHERE a.t = b.t) AS tt FROM top a JOIN top b ON a.g = b.g AND a.rn < b.rn GROUP BY a.g)"""


@query("g string, tau double, n_distinct bigint", f"WITH {BRAND_SQL}, {TAU.format(ids='i1, i2, i3, i4', n=100)} SELECT pr.g, CASE WHEN pairs > ts AND pairs > tt THEN c / sqrt((pairs - ts)::DOUBLE * (pairs - tt)) END AS tau, (SELECT count(DISTINCT t) FROM top WHERE top.g = pr.g) AS n_distinct FROM pr")
def kendall_tau_top(spark, sf):
    return rank.tau_top(brand(spark, sf), "s", 100)


@query("g bigint, n bigint, width double, n_distinct bigint", f"WITH {PART_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS rn FROM m) SELECT g, count(*) AS n, max(t) / min(t) - 1 AS width, count(DISTINCT t) AS n_distinct FROM o WHERE rn <= 10 GROUP BY g")
def top_span(spark, sf):
    return rank.top_span(part(spark, sf), 10)


@query("g bigint, rn bigint, distance bigint", f"WITH {PART_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS rn FROM m) SELECT b.g, b.rn, (a.i1 <> b.i1)::INT + (a.i2 <> b.i2)::INT + (a.i3 <> b.i3)::INT AS distance FROM o a JOIN o b ON a.g = b.g AND a.rn = 1 AND b.rn BETWEEN 2 AND 10")
def axis_distance(spark, sf):
    return rank.axis_distance(part(spark, sf), ("i1", "i2", "i3"), 10)


@query("g bigint, i1 bigint, i2 bigint, i3 string, t double, sigma double", f"WITH {ST}, o AS (SELECT m.*, (t - best) / best / floor AS sigma, row_number() OVER (PARTITION BY m.g, i3, t ORDER BY i1, i2) AS dup FROM m JOIN st ON m.g = st.g), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, i1, i2, i3) AS rn FROM o WHERE dup = 1) SELECT g, i1, i2, i3, t, sigma FROM p WHERE rn <= 5")
def neighbours(spark, sf):
    return rank.neighbours(part(spark, sf), F.concat_ws("|", "i3", "t"), 5)


@query("g bigint, total_rank bigint, n_rules bigint, n_tied bigint", f"WITH {PART_SQL}, r AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY s) + dense_rank() OVER (PARTITION BY g ORDER BY s2) - 2 AS total FROM m), b AS (SELECT g, min(total) AS best FROM r GROUP BY g) SELECT r.g, any_value(best) AS total_rank, 2 AS n_rules, count(*) FILTER (WHERE total = best) AS n_tied FROM r JOIN b ON r.g = b.g GROUP BY r.g")
def rank_ensemble(spark, sf):
    return rank.rank_ensemble(part(spark, sf), ("s", "s2"))


@query("k bigint, cascade double, ceiling double, hit double, floor double, closed double", f"WITH {ST}, o AS (SELECT m.*, best, row_number() OVER (PARTITION BY m.g ORDER BY s, i1, i2, i3) AS rn FROM m JOIN st ON m.g = st.g), w AS (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY s2, i1, i2, i3) AS rb FROM o, (SELECT unnest([3, 10]) AS k) WHERE rn <= k), p AS (SELECT g, k, any_value(best) AS best, min(t) FILTER (WHERE rb = 1) AS t, min(t) AS lo, avg(t) AS mid FROM w GROUP BY g, k), a AS (SELECT k, exp(avg(ln(t / best))) AS cascade, exp(avg(ln(lo / best))) AS ceiling, avg((lo = best)::INT) AS hit, exp(avg(ln(mid / best))) AS floor FROM p GROUP BY k) SELECT *, 1 - (cascade - ceiling) / (floor - ceiling) AS closed FROM a")
def cascade(spark, sf):
    return rank.cascade(part(spark, sf), "s", "s2", (3, 10))


@query("draw bigint, regret double", f"WITH {BST}, d AS (SELECT unnest(range(0, 5)) AS draw), o AS (SELECT m.g, t, draw, row_number() OVER (PARTITION BY m.g, draw ORDER BY md5(concat_ws('|', i1, i2, i3, i4, draw)), i1, i2, i3, i4) AS rn FROM m, d) SELECT draw, {GEO.format('(t / best)')} AS regret FROM o JOIN st ON o.g = st.g WHERE rn = 1 GROUP BY draw")
def random_floor(spark, sf):
    return rank.random_floor(brand(spark, sf), 5)


@query("class string, n bigint", f"WITH {part_sql('a', chr(87) + 'HERE l_linestatus = ' + chr(39) + 'F' + chr(39))}, {part_sql('b', chr(87) + 'HERE l_linestatus = ' + chr(39) + 'O' + chr(39))}, x AS (SELECT DISTINCT g, i1 FROM a), y AS (SELECT DISTINCT g, i1 FROM b) SELECT CASE WHEN x.g IS NULL THEN 'b_only' WHEN y.g IS NULL THEN 'a_only' ELSE 'both' END AS class, count(*) AS n FROM x FULL JOIN y ON x.g = y.g AND x.i1 = y.i1 GROUP BY 1")
def axis_intersection(spark, sf):
    return rank.axis_sets(part_by_status(spark, sf, "F"), part_by_status(spark, sf, "O"), ("i1",))
