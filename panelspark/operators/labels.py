"""Label tables: merging sources, feedback, weights, calibration, folds, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.config import EquivalentDay, SampleWeights
from panelspark.functions.numeric import pseudo_iwsr
from panelspark.operators.daily import year_end
from panelspark.operators.physics import terminal_equivalent_days
from panelspark.operators.scale import cumulative, exact_quantiles, hash_positions


def drop_censored(df: DataFrame, enabled: bool = True, flag: str = "iwsr_censored") -> DataFrame:
    """Drop censored rows when the flag exists and the option is on."""
    if not enabled or flag not in df.columns:
        return df
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def risk_label(iwsr: Column, threshold: float) -> Column:
    """Strictly below the threshold."""
    return (iwsr < threshold).cast("int")


def merged_labels(panel: DataFrame, summary: DataFrame, as_of: Column, threshold: float,
                  censored: bool = True) -> DataFrame:
    """U01 + J07: panel rows, plus summary rows of stations the panel lacks (kept even when censored)."""
    years = drop_censored(panel, censored).withColumn("as_of", year_end(F.col("year"))).withColumn("is_summary", F.lit(False))
    known = panel if not censored else drop_censored(panel)
    extra = summary.join(known.select("station_id").distinct(), "station_id", "left_anti").withColumn(
        "as_of", as_of).withColumn("year", F.year("as_of")).withColumn("is_summary", F.lit(True))
    both = years.unionByName(extra, allowMissingColumns=True)
    return both.withColumn("label", risk_label(F.col("iwsr"), threshold))


def with_feedback(labels: DataFrame, feedback: DataFrame) -> DataFrame:
    """U02."""
    return labels.withColumn("is_feedback", F.lit(False)).unionByName(feedback, allowMissingColumns=True)


def feedback_labels(feedback: DataFrame, centroids: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """J06 + F21 + S23: labelled rows of measured cleanings, and the events whose array is unknown."""
    keys = ["partner_id", "array_id"]
    iwsr = pseudo_iwsr(F.col("actual_recovery_pct"))
    rows = feedback.join(centroids.select(*keys, "latitude", "longitude"), keys).select(
        F.concat("partner_id", F.lit("_array_"), F.col("array_id").cast("string")).alias("station_id"), "latitude", "longitude",
        F.to_date("cleaned_at").alias("as_of"), iwsr.alias("iwsr"), risk_label(iwsr, threshold).alias("label"),
        F.year(F.to_date("cleaned_at")).alias("year"), F.lit(True).alias("is_feedback"))
    return rows, feedback.join(centroids.select(*keys), keys, "left_anti")


def label_distribution(labels: DataFrame) -> DataFrame:
    """A16."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("stations"))


def ingest_profile(panel: DataFrame) -> DataFrame:
    """One row. States are few, so the sorted set stays small."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("iwsr_censored").alias("n_censored"),
        F.count_distinct("station_id").alias("n_stations"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.array_sort(F.collect_set("state")).alias("states"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in input order, pre-combined map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*keys, "_f.*")


def sample_weights(df: DataFrame, cfg: SampleWeights = SampleWeights(), out: str = "weight") -> DataFrame:
    """Uniform or inverse interval width (clipped to percentiles), then the summary and feedback factors."""
    if cfg.mode == "uniform" or not {"iwsr_lower", "iwsr_upper"} <= set(df.columns):
        if cfg.mode not in ("uniform", "iwsr_ci_width"):
            raise ValueError(f"unknown sample weight mode {cfg.mode!r}")
        w = df.withColumn("_w", F.lit(1.0))
    elif cfg.mode == "iwsr_ci_width":
        width = F.col("iwsr_upper") - F.col("iwsr_lower")
        wide = df.withColumn("_width", F.when(width > 0, width))
        mid = exact_quantiles(wide, "_width", {"_mid": 0.5}).drop("n")
        filled = F.coalesce("_width", "_mid", F.lit(cfg.empty_width))
        raw = wide.crossJoin(F.broadcast(mid)).withColumn("_raw", F.lit(1.0) / F.greatest(filled, F.lit(cfg.min_width)))
        lo, hi = cfg.clip_percentiles
        limits = exact_quantiles(raw.select("_raw"), "_raw", {"_lo": lo / 100.0, "_hi": hi / 100.0}).drop("n")
        w = raw.crossJoin(F.broadcast(limits)).withColumn("_w", F.greatest("_lo", F.least("_hi", "_raw")))
    else:
        raise ValueError(f"unknown sample weight mode {cfg.mode!r}")
    factor = F.col("_w")
    if "is_summary" in df.columns:
        factor = factor * F.when(F.coalesce("is_summary", F.lit(False)), F.lit(cfg.summary_factor)).otherwise(F.lit(1.0))
    if "is_feedback" in df.columns:
        factor = factor * F.when(F.coalesce("is_feedback", F.lit(False)), F.lit(cfg.feedback_multiplier)).otherwise(F.lit(1.0))
    return w.withColumn(out, factor).select(*df.columns, out)


# The searched grid.
K_GRID = (5, 10, 20, 30, 45, 60, 90)
SAT_GRID = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40)


def calibration_grid(rows: DataFrame, measured: DataFrame, keys: Sequence[str], k_grid: Sequence[float] = K_GRID,
                     sat_grid: Sequence[float] = SAT_GRID, min_rows: int = 10) -> DataFrame:
    """M13 + J18 + A22: mean absolute error per parameter pair, global (zone null) and per zone.

    Equivalent days depend on neither parameter, so each trajectory is folded once. The 49 predictions per label
    row are summed in the same task (one array per row, positional partial sums), and only 49 sums per zone leave it.
    """
    eqd = terminal_equivalent_days(rows, keys, EquivalentDay()).select(*keys, "eqd")
    grid = [(float(k), float(s)) for k in k_grid for s in sat_grid]
    joined = eqd.join(measured, list(keys))
    errors = [
        F.sum(F.abs(F.lit(1.0) - F.lit(s) * (F.lit(1.0) - F.exp(-F.col("eqd") / F.lit(k))) - F.col("iwsr"))).alias(f"e{i}")
        for i, (k, s) in enumerate(grid)]
    sums = joined.rollup("zone").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_all"), *errors)
    combos = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("sl_sat"), F.lit(i).alias("ord"),
                                (F.col(f"e{i}") / F.col("n")).alias("mae")) for i, (k, s) in enumerate(grid)])
    return sums.where((F.col("_all") == 1) | (F.col("n") >= min_rows)).select("zone", "n", F.inline(combos))


def best_parameters(grid: DataFrame) -> DataFrame:
    """The first best pair of each zone."""
    best = grid.groupBy("zone", "n").agg(F.min_by(F.struct("k", "sl_sat", "mae"), F.struct("mae", "ord")).alias("_b"))
    return best.select("zone", "n", "_b.*")


def fold_pattern(classes: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, list[int]]]:
    """(size, first rank, folds in turn) for clusters given by (size, how many), sizes falling.

    Largest first onto the lightest fold. Of clusters of one size, the lightest folds take one each in turn until they
    reach the load of the next one; so a class is a few runs, each a list of folds over and over.
    """
    loads, runs = [0] * n_folds, []
    for size, many in classes:
        rank = 0
        while rank < many:
            low = sorted(range(n_folds), key=lambda f: (loads[f], f))
            # Those that take one each before the first of them is the lightest again.
            turn = [low[0]]
            for f in low[1:]:
                if (loads[low[0]] + size, low[0]) < (loads[f], f):
                    break
                turn.append(f)
            above = low[len(turn)] if len(turn) < n_folds else None
            # Whole turns until the last of them would come behind the next fold.
            turns = (many - rank) // len(turn) if above is None else (loads[above] - loads[turn[-1]]) // size
            turns = max(1, min(turns, (many - rank) // len(turn)))
            take = min(turns * len(turn), many - rank)
            runs.append((size, rank, turn))
            for i, f in enumerate(turn):
                loads[f] += size * (take // len(turn) + (i < take % len(turn)))
            rank += take
    return runs


def assign_folds(df: DataFrame, cluster: str = "cluster", n_folds: int = 5) -> DataFrame:
    """Whole clusters to folds, the largest first onto the lightest fold; ties by cluster, the last first.

    The driver sees how many clusters have each size: distinct sizes number at most the root of twice the rows. A
    cluster's fold follows from its rank in its size class.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    classes = [(r["n"], r["many"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("n")).collect()]
    folds = min(n_folds, max(1, sum(many for _, many in classes)))
    runs = fold_pattern(classes, folds)
    ranked = cumulative(sizes.withColumn("_one", F.lit(1)), cluster, {"_upto": "_one"}, ["n"])
    many = df.sparkSession.createDataFrame(classes, "n long, _many long")
    starts = df.sparkSession.createDataFrame(runs, "n long, _first long, _turn array<int>")
    # Clusters of a class count from the last one.
    ranked = ranked.join(many, "n").withColumn("_rank", F.col("_many") - F.col("_upto"))
    ends = starts.withColumn("_next", F.lead("_first").over(W.partitionBy("n").orderBy("_first")))
    here = ranked.join(ends, (ranked["n"] == ends["n"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_next").isNull() | (F.col("_rank") < F.col("_next"))))
    fold = F.get("_turn", F.pmod(F.col("_rank") - F.col("_first"), F.size("_turn")).cast("int"))
    return df.join(here.select(cluster, fold.alias("fold")), cluster)


def fold_composition(df: DataFrame, top: int = 8) -> DataFrame:
    """Size, balance and extent of each fold, and its most frequent stations."""
    base = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station_id").alias("n_stations"),
        F.count_distinct("cluster").alias("n_clusters"), F.avg("label").alias("pos_rate"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"))
    per = df.groupBy("fold", "station_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("fold").orderBy(F.desc("n"), "station_id"))
    best = per.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("fold").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "station_id", "n"))),
        lambda s: F.concat_ws(":", s["station_id"].cast("string"), s["n"].cast("string"))), ",").alias("top_stations"))
    return base.join(best, "fold")


def seeded_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Exact split sizes in a fixed hash order: int(train n), int(val n), the rest."""
    placed = hash_positions(df, key, seed, "_pos")
    a, b = F.floor(F.col("total") * F.lit(train)), F.floor(F.col("total") * F.lit(val))
    split = F.when(F.col("_pos") < a, "train").when(F.col("_pos") < a + b, "val").otherwise("test")
    return placed.withColumn("split", split).select(*df.columns, "split")


def group_split(df: DataFrame, group: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """The same split over distinct groups, so a group stays in one split."""
    return df.join(seeded_split(df.select(group).distinct(), group, seed, train, val), group)


def limit_background(tiles: DataFrame, key: str, max_empty_ratio: float, seed: int = 42, flag: str = "has_labels") -> DataFrame:
    """Keep all labelled tiles and at most int(pos r / (1 - r)) empty ones; all when nothing is labelled."""
    counts = tiles.agg(F.count_if(flag).alias("_pos"))
    quota = F.floor(F.col("_pos") * max_empty_ratio / max(1e-9, 1 - max_empty_ratio))
    empty = hash_positions(tiles.where(~F.col(flag)), key, seed, "_i").drop("total")
    kept = empty.crossJoin(F.broadcast(counts)).where((F.col("_pos") == 0) | (F.col("_i") < quota)).select(*tiles.columns)
    return tiles.where(flag).unionByName(kept)


def nested_subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first N of a fixed hash order; a larger N contains every smaller one."""
    return hash_positions(df, key, seed, "_i").where(F.col("_i") < n).select(*df.columns)


def sparse_features(df: DataFrame, meta: Sequence[str], min_fraction: float = 0.2) -> list[str]:
    """Non-meta columns filled in less than the fraction of rows (one aggregation, one row back)."""
    columns = [c for c in df.columns if c not in meta]
    shares = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in columns]).first()
    return [c for c in columns if shares[c] is not None and shares[c] < min_fraction]


def drop_sparse(df: DataFrame, meta: Sequence[str], min_fraction: float = 0.2) -> DataFrame:
    return df.drop(*sparse_features(df, meta, min_fraction))


def acceptance_gates(metrics: DataFrame, min_auc: float = 0.70, min_rho: float = 0.40) -> DataFrame:
    """Gate columns on a metrics table with mean_auc and spearman."""
    auc, rho = F.col("mean_auc") >= min_auc, F.abs("spearman") >= min_rho
    return metrics.withColumn("auc_pass", F.coalesce(auc, F.lit(False))).withColumn(
        "validation_gate", F.when(rho, "PASS").otherwise("BELOW_GATE")).withColumn("beta", ~F.coalesce(auc, F.lit(False)))


def ramp_steps(results: DataFrame, baseline: float = 0.563, halt_delta: float = 0.07, order: str = "step") -> DataFrame:
    """W14 + D03: regression against the baseline and the previous step, halt flag, step status.

    Steps are few by nature; only this small result table is ordered.
    """
    delta = F.lit(baseline) - F.col("map50")
    prev = F.lag("map50").over(W.partitionBy(F.lit(0)).orderBy(order))
    halt = F.coalesce(delta > halt_delta, F.lit(False))
    return results.withColumn("regression_delta", delta).withColumn("step_delta", F.col("map50") - prev).withColumn(
        "halt", halt).withColumn("status", F.when(halt, "halt").when(F.col("precision") < 0.25, "soft_halt").otherwise("ok"))
