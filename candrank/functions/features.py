"""Feature catalogues: each feature is one SQL expression over a group's, a candidate's and the parameters' columns.

The built-in catalogue describes tiled matrix products: group M, N, K, dtype; candidate tile_m, tile_n,
tile_k, split_k, split_k_mode, threads, max_blocks_per_sm, smem_bytes, regs_per_thread, spill_bytes,
pipeline_kind, inst_total; parameters sm_count, smem_per_block, max_threads_per_sm, regs_per_sm, ridge_point.
What several features need is a shared part: it is computed once, before the features, in a column of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    name: str
    sql: str
    low: float
    high: float
    level: str = "candidate"
    direction: str = "neutral"


WORSE = "higher_is_worse"

# What the features of both catalogues share; a part may name those before it. An unknown type is an error, not a guess.
PARTS = {
    "p_bytes": "(CASE dtype WHEN 'f16' THEN 2 WHEN 'bf16' THEN 2 WHEN 'f8' THEN 1 WHEN 'f32' THEN 4 ELSE CAST(raise_error('unknown dtype') AS INT) END)",
    "p_gm": "ceil(M / tile_m)",
    "p_gn": "ceil(N / tile_n)",
    "p_tiles": "p_gm * p_gn * split_k",
    "p_waves": "p_tiles / (sm_count * greatest(1, max_blocks_per_sm))",
    "p_full": "ceil(greatest(1e-12, p_waves))",
    "p_tail": "(p_full - greatest(1e-12, p_waves)) / p_full",
    "p_traffic": "p_gm * p_gn * (tile_m + tile_n) * K * p_bytes",
    "p_iters": "greatest(1e0, K / (tile_k * split_k))",
    "p_intensity": "2e0 * M * N * K / greatest(1e0, p_bytes * (M * K + K * N + M * N))",
    # of the second catalogue, which needs warp_m, warp_n, warp_k, stages, l2_bytes, peak_tflops_f16 and bandwidth_gbps too; two bytes an element
    "p_threads": "32e0 * (tile_m / warp_m) * (tile_n / warp_n) * (tile_k / warp_k)",
    "p_stage_bytes": "tile_m * tile_k * 2 + tile_n * tile_k * 2",
    "p_smem_share": "smem_bytes / smem_per_block",
    "p_by_smem": "least(floor(smem_per_block / smem_bytes), 32e0)",
    "p_regs": "tile_m * tile_n / p_threads",
    "p_by_regs": "floor(regs_per_sm / (p_regs * p_threads))",
    "p_resident": "greatest(1e0, least(p_by_smem, p_by_regs))",
    "p_slots": "sm_count * p_resident",
    "p_k_iters": "ceil(ceil(K / split_k) / tile_k)",
    "p_ab": "2 * M * K + 2 * K * N",
    # there are no clusters here: one block each way
    "p_cluster_m": "1e0",
    "p_cluster_n": "1e0",
}
_PART = re.compile(r"\bp_[a-z_]+\b")

# Names, formulas, expected ranges.
PHYSICAL = (
    Feature("log_grid_tiles", "log2(1e0 + p_tiles)", 1, 1e7),
    Feature("waves", "p_waves", 0, 1e5),
    Feature("tail_waste", "p_tail", 0, 1, direction=WORSE),
    Feature("sm_idle_cost", "1e0 / greatest(1e-3, 1e0 - p_tail) - 1e0", 0, 10, direction=WORSE),
    Feature("edge_waste", "(p_gm * tile_m / M) * (p_gn * tile_n / N) - 1e0", 0, 300, direction=WORSE),
    Feature("log_dram_traffic", "log2(1e0 + p_traffic)", 0, 100, direction=WORSE),
    Feature("traffic_amplification", "p_traffic / greatest(1e0, p_bytes * (M * K + K * N))", 0, 200, direction=WORSE),
    Feature("tile_aspect_imbalance", "abs(log2(tile_m / tile_n))", 0, 8, direction=WORSE),
    Feature("log_mainloop_iters", "log2(p_iters)", 0, 16),
    Feature("pipeline_warmup_frac", "least(4e0, greatest(1e0, smem_bytes / greatest(1e0, tile_k * (tile_m + tile_n) * p_bytes)) / p_iters)", 0, 4, direction=WORSE),
    Feature("split_k_cost", "log2(split_k) / 4e0", 0, 1, direction=WORSE),
    Feature("log_workspace_bytes", "CASE WHEN split_k_mode = 'parallel' THEN log2(1e0 + p_bytes * M * N * split_k) ELSE 0e0 END", 0, 40, direction=WORSE),
    Feature("smem_pressure", "smem_bytes / smem_per_block", 0, 1.5, direction=WORSE),
    Feature("reg_pressure", "regs_per_thread * threads / regs_per_sm", 0, 4, direction=WORSE),
    Feature("occupancy_deficit", "1e0 - least(1e0, greatest(0e0, max_blocks_per_sm * threads / max_threads_per_sm))", 0, 1, direction=WORSE),
    Feature("has_spill", "CASE WHEN spill_bytes > 0 THEN 1e0 ELSE 0e0 END", 0, 1, direction=WORSE),
    Feature("spill_magnitude", "log2(1e0 + spill_bytes) / 4e0", 0, 10, direction=WORSE),
    Feature("is_two_stage", "CASE WHEN pipeline_kind = 'pipelined' THEN 1e0 ELSE 0e0 END", 0, 1, direction=WORSE),
    Feature("log_inst_total", "log2(1e0 + inst_total)", 0, 30, direction=WORSE),
    Feature("arith_intensity", "p_intensity", 0, 1e5, "group"),
    Feature("roofline_ratio", "p_intensity / ridge_point", 0, 1e4, "group"),
    Feature("is_memory_bound", "CASE WHEN p_intensity / ridge_point < 1e0 THEN 1e0 ELSE 0e0 END", 0, 1, "group"),
    Feature("log_flops", "log2(greatest(1e0, 2e0 * M * N * K))", 0, 80, "group"),
    Feature("aspect_MN", "log2(greatest(1e0, M) / greatest(1e0, N))", -30, 30, "group"),
    Feature("reuse_ratio", "1e0 * M * N * K / greatest(1e0, M * K + K * N + M * N)", 0, 1e5, "group"),
    Feature("log_min_dim", "log2(greatest(1e0, least(M, N, K)))", 0, 30, "group"),
    Feature("can_use_cp_async", "CASE WHEN least(M, N, K) > 0 AND K % (16 / p_bytes) = 0 AND N % (16 / p_bytes) = 0 THEN 1e0 ELSE 0e0 END", 0, 1, "group"),
)

# The second catalogue.
HARDWARE_AWARE = tuple(
    Feature(name, sql, float("-inf"), float("inf"))
    for name, sql in (
        ("log2_M", "log2(M)"), ("log2_N", "log2(N)"), ("log2_K", "log2(K)"), ("tile_m_f", "tile_m"), ("tile_n_f", "tile_n"), ("tile_k_f", "tile_k"), ("stages_f", "stages"), ("cluster_m_f", "p_cluster_m"), ("cluster_n_f", "p_cluster_n"),
        ("sm_subscription", "p_tiles / p_slots"), ("last_wave_eff", "p_tiles / (ceil(p_tiles / p_slots) * p_slots)"), ("tiles_m", "p_gm"), ("tiles_n", "p_gn"), ("k_iters", "p_k_iters"),
        ("m_quant_waste", "(p_gm * tile_m - M) / M"), ("n_quant_waste", "(p_gn * tile_n - N) / N"), ("mainloop_compute_intensity", "2e0 * tile_m * tile_n / (tile_m * 2 + tile_n * 2)"),
        ("tile_aspect_ratio", "log2(tile_m / tile_n)"), ("problem_arith_intensity", "2e0 * M * N * K / (2 * M * K + 2 * K * N + 2 * M * N)"), ("restream_factor", "(p_gn * 2 * M * K + p_gm * 2 * K * N) / p_ab"),
        ("working_set_vs_l2", "p_ab / l2_bytes"), ("fits_l2", "CASE WHEN p_ab < l2_bytes THEN 1e0 ELSE 0e0 END"), ("resident_panel_vs_l2", "least(2 * tile_m * K, 2 * tile_n * K) / l2_bytes"),
        ("smem_total", "smem_bytes"), ("smem_frac", "p_smem_share"), ("blocks_per_sm", "p_by_smem"), ("reg_pressure_proxy", "p_regs"), ("reg_limited_blocks", "p_by_regs"), ("true_blocks", "p_resident"), ("bytes_per_stage", "p_stage_bytes"),
        ("producer_consumer_ratio", "(2e0 * tile_m * tile_n * tile_k / (peak_tflops_f16 * 1e12 / sm_count)) / (p_stage_bytes / (bandwidth_gbps * 1e9))"),
        ("pipeline_fill_frac", "least(stages, p_k_iters) / stages"), ("stage_amortization", "p_k_iters / stages"), ("stages_vs_smem", "stages * p_smem_share"),
        ("streamk_applicability", "greatest(0e0, 1e0 - p_gm * p_gn / (ceil(p_gm * p_gn / p_slots) * p_slots))"), ("is_streamk", "CASE WHEN split_k > 1 THEN 1e0 ELSE 0e0 END"),
        ("cluster_size", "p_cluster_m * p_cluster_n"), ("cluster_fits_m", "p_gm / p_cluster_m"), ("cluster_fits_n", "p_gn / p_cluster_n"), ("cluster_overshoots", "CASE WHEN p_cluster_m > p_gm OR p_cluster_n > p_gn THEN 1e0 ELSE 0e0 END"),
        ("warp_m_f", "warp_m"), ("warp_n_f", "warp_n"), ("warp_k_f", "warp_k"), ("split_k_f", "split_k"), ("swizzle_n_f", "swizzle_n"), ("align_a_f", "align_a"), ("align_b_f", "align_b"), ("align_c_f", "align_c"),
    )
)


def level_code(column: str, levels: tuple[str, ...]) -> Column:
    """Place of a value in fixed levels, from 0; any other value is an error when it is read."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column))
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit(f"{column}: not one of its levels: "), F.coalesce(F.col(column), F.lit("null")))).cast("long"))


# Fixed value: launch order of each swizzle kind.
RASTERS = {"identity": "along_m", "horizontal": "along_n"}


def raster_of(kind: Column, width: Column) -> Column:
    """Struct of the launch order and its width; no kind gives '' and 0, no width 0, an unknown kind is an error when it is read."""
    order = F.create_map(*[F.lit(x) for kv in RASTERS.items() for x in kv])[kind]
    unknown = F.raise_error(F.concat(F.lit("unknown swizzle kind "), kind)).cast("string")
    return F.struct(F.when(kind.isNull(), "").when(order.isNull(), unknown).otherwise(order).alias("raster_order"), F.when(kind.isNull(), 0).otherwise(F.coalesce(width, F.lit(0))).cast("long").alias("raster_width"))


def expanded(sql: str) -> str:
    """The expression without shared parts."""
    while _PART.search(sql):
        sql = _PART.sub(lambda m: f"({PARTS[m[0]]})", sql)
    return sql


def parts_of(features: Iterable[Feature]) -> list[list[str]]:
    """The shared parts that the features need, level by level: each names parts of earlier levels only."""
    level: dict[str, int] = {}

    def place(sql: str) -> int:
        for name in _PART.findall(sql):
            if name not in level:
                level[name] = place(PARTS[name])
        return 1 + max((level[n] for n in _PART.findall(sql)), default=-1)

    for f in features:
        place(f.sql)
    return [[n for n in PARTS if level.get(n) == i] for i in range(1 + max(level.values(), default=-1))]


def with_features(df: DataFrame, features: Iterable[Feature], strict: bool = True, prefix: str = "") -> DataFrame:
    """df with the features: shared parts first, then the features, then one check; with strict a value that is not finite is an error when it is read."""
    features, own = list(features), df.columns
    levels = parts_of(features)
    for level in levels:
        df = df.select("*", *[F.expr(PARTS[n]).alias(n) for n in level])
    names = [prefix + f.name for f in features]
    columns = [F.expr(f.sql).cast("double").alias(n) for f, n in zip(features, names)]
    if not strict:
        return df.select(*own, *columns)
    # nothing but a finite number gives 0 times 0. A projection with a function of an array is compiled in small
    # methods, where one of many plain expressions is a method that is too long for the JVM to optimise
    finite = lambda cols: F.forall(F.array(F.lit(0.0), *[F.col(c).cast("double") for c in cols]), lambda x: x * 0 == 0)
    df = df.select(*own, finite([n for level in levels for n in level]).alias("__parts"), *columns)
    df = df.select(*own, *names, (F.col("__parts") & finite(names)).alias("__whole"))
    return df.select(*own, *[F.when(F.col("__whole"), F.col(n)).otherwise(F.raise_error(F.lit(f"{n} or what is computed beside it is not finite")).cast("double")).alias(n) for n in names])
