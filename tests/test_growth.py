"""Steps that handle many tiles or groups at once: against plain versions, and how much they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import components as C
from panelspark.operators import detect as M


def boxes(rng, tiles, names):
    rows = []
    for tile, n in tiles:
        for k in range(1, n + 1):
            x, y, w = rng.integers(0, 300), rng.integers(0, 300), rng.integers(5, 60)
            rows.append((tile, k, *[float(v) for v in (x, y, x + w, y + w)]))
    return rows, f"tile_id bigint, {names} int, x1 double, y1 double, x2 double, y2 double"


def test_rows_of_one_pass_equal_those_of_joins(spark):
    rng = np.random.default_rng(3)
    # Tiles of one side only, a crowded one, a null key, a box without a corner.
    p, kind = boxes(rng, [(1, 4), (2, 70), (4, 3), (None, 2), (5, 1)], "pred_idx")
    g, kind_g = boxes(rng, [(1, 3), (2, 80), (3, 2), (None, 2), (5, 1)], "gt_idx")
    preds = spark.createDataFrame([*p, (1, 5, None, 1.0, 2.0, 3.0)], kind).withColumn("conf", 1 / F.col("pred_idx"))
    gts = spark.createDataFrame([*g, (3, 3, 0.0, 0.0, None, 5.0)], kind_g)
    one = M.matched_rows(preds, gts, 0.2)
    joined = M.detection_rows(preds, gts, M.match(preds, gts, 0.2))
    assert one.dtypes == joined.dtypes
    assert one.exceptAll(joined).isEmpty() and joined.exceptAll(one).isEmpty()
    assert one.where("class = 'tp'").count() > 10
    # Each side is shuffled once; pairs are not.
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_crowded_tiles_meet_in_cells_each_pair_once():
    rng = np.random.default_rng(5)
    low_p, low_g = rng.integers(0, 500, (200, 2)), rng.integers(0, 500, (150, 2))
    p, g = (np.concatenate([low, low + rng.integers(1, 200, low.shape)], axis=1).astype(float) for low in (low_p, low_g))
    tp, tg = np.sort(rng.integers(0, 2, 200)), np.sort(rng.integers(0, 2, 150))
    found = [(a, b) for i, j in M.box_candidates(p, tp, g, tg, 128.0) for a, b in zip(i.tolist(), j.tolist())]
    meet = (tp[:, None] == tg) & (M._ious(np.repeat(p, 150, axis=0), np.tile(g, (200, 1))).reshape(200, 150) > 0)
    assert len(found) == len(set(found)) and set(found) >= set(zip(*(v.tolist() for v in np.nonzero(meet))))


def test_hulls_of_many_groups_equal_single_ones():
    rng = np.random.default_rng(1)
    for m, few in ((3, 0), (8, 8), (50, 2)):
        C.FEW_GROUPS, before = few, C.FEW_GROUPS
        group = np.sort(rng.integers(0, 60, 900))
        group = np.unique(group, return_inverse=True)[1]
        x, y = rng.integers(0, m, 900).astype(float), rng.integers(0, m, 900).astype(float)
        rows, owner = C.hulls(x, y, group)
        C.FEW_GROUPS = before
        for k in range(group.max() + 1):
            want = C._hull(list(zip(x[group == k].tolist(), y[group == k].tolist())))
            assert list(zip(x[rows[owner == k]].tolist(), y[rows[owner == k]].tolist())) == want


@pytest.mark.parametrize("together", [200_000, 50])
def test_panels_merge_alike_in_one_task_and_by_joins(spark, monkeypatch, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = np.random.default_rng(2)
    rows = [(t, k, float(rng.integers(0, 240)), float(rng.integers(0, 240))) for t, n in ((1, 3), (2, 120), (3, 40), (None, 1)) for k in range(n)]
    rows += [(1, 50, *rows[0][2:]), (1, 51, 900.0, 900.0)]
    df = spark.createDataFrame(rows, "tile_id bigint, gt_idx int, cx double, cy double").withColumn("x1", F.col("cx") - 1)
    got = {(r.tile_id, r.gt_idx): r.cluster for r in C.merge_panels(df.where("tile_id is not null"), keep=["x1"]).collect()}
    for t in (1, 2, 3):
        own = {k: np.array(v) for tile, k, *v in rows if tile == t}
        left = set(own)
        while left:
            seen, todo = set(), [min(left)]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += [j for j in left if np.hypot(*(own[j] - own[k])) <= 20]
            assert {got[t, k] for k in seen} == {min(seen)}
            left -= seen
    assert len(got) == len(rows) - 1


def test_tables_are_read_once_for_ranks_and_sizes(spark, tables):
    from panelspark.operators import quality as Q
    from panelspark.operators import stats as S
    from panelspark.plans.quality import LINES

    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(S.spearman(tables.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])) == 0
    assert scans(Q.size_stats(tables.sql(LINES))) == 0
    # Means and deviations take one more pass.
    assert scans(S.summarize(tables.lineitem, ["l_quantity"], ["l_returnflag"])) == 1


def test_rounding_of_whole_columns_equals_the_expression(spark):
    from panelspark.functions import numeric as X

    values = [None, float("nan"), float("inf"), 0.5, 2.675, 1.005, -1.005, 0.125, 0.375, -0.125, 1e11 + 0.5, 12.34565, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 4):
        row = df.select(X.blank_rounds(digits)("v").alias("a"), X.blank_round(F.col("v"), digits).alias("b"))
        assert row.where("not a <=> b").isEmpty()


def test_many_cells_share_a_call(spark, monkeypatch):
    from panelspark.operators import polygons as P

    calls = spark.sparkContext.accumulator(0)
    link_cells = P._link_cells

    def counting(*args):
        run = link_cells(*args)

        def counted(rows):
            calls.add(1)
            return run(rows)

        return counted

    monkeypatch.setattr(P, "_link_cells", counting)
    # Pairs of overlapping boxes, each pair far from the others and so in cells of its own.
    rows = [(2 * k + i, 1000.0 * k + 5 * i, 0.0, 1000.0 * k + 5 * i + 10, 10.0) for k in range(100) for i in (0, 1)]
    df = spark.createDataFrame(rows, "array_id bigint, minx double, miny double, maxx double, maxy double")
    got = {r.array_id: r.component for r in P.dissolve(df).collect()}
    assert got == {k: k // 2 * 2 for k in range(200)}
    assert calls.value == 1


def test_a_mean_on_the_threshold_is_rounded_as_the_loop_rounds_it(spark):
    import datetime as dt

    from panelspark.operators import physics as P

    kind = "station_id bigint, as_of date, dt date, precipitation_sum double, pm2_5 double"
    day, rng = dt.date(2026, 1, 1), np.random.default_rng(4)
    # Losses that add up to three times 0.03; then series of several stretches with rain among them.
    series = {k: ([0.0] * 3, list(pm)) for k, pm in enumerate([(11.0, 57.0, 3.0), (23.0, 40.0, 1.0), (22.0, 28.0, 28.0), (6.0, 47.0, 38.0)])}
    series |= {k: ([float(v) for v in rng.random(150) > 0.97], [float(v) / 2 for v in rng.integers(2, 100, 150)]) for k in (4, 5)}
    rows = [(k, day, day + dt.timedelta(days=i), r, p) for k, (rain, pm) in series.items() for i, (r, p) in enumerate(zip(rain, pm))]
    df = spark.createDataFrame(rows, kind).repartition(3)
    got = {r.station_id: r for r in P.kimber_labels(df, ["station_id", "as_of"]).collect()}
    path = {(r.station_id, r.dt): r.soiling_ratio for r in P.kimber_ratio(df, ["station_id", "as_of"]).collect()}
    for k, (rain, pm) in series.items():
        now, total = 1.0, 0.0
        for i, (r, p) in enumerate(zip(rain, pm)):
            now = 1.0 if r >= 1 else max(0.0, now - 0.0006 * p)
            total += now
            assert path[k, day + dt.timedelta(days=i)] == now
        assert (got[k].iwsr, got[k].label) == (total / len(pm), int(total / len(pm) < 0.97))


def test_neighbouring_locations_share_a_state(spark, tmp_path):
    import datetime as dt

    from panelspark.streaming import streams as T

    kind = "station_id bigint, dt date, precipitation_sum double, pm2_5 double, pm10 double"
    first, rng = dt.date(2026, 1, 1), np.random.default_rng(6)
    day = lambda i: first + dt.timedelta(days=i)
    # Gaps, missing readings, a location below zero, rows without a location.
    stations = [-1, *range(100), None, 1 << 40]
    rows = [(s, i, float(rng.choice([0.0, 0.5, 1.0, 4.0, 12.0], p=[0.6, 0.1, 0.1, 0.15, 0.05])), float(rng.integers(1, 400)), float(rng.integers(1, 120)))
            for s in stations for i in range(30) if s is None or (s + i) % 5]
    rows = [(s, i, *[None if rng.random() < 0.05 else v for v in values]) for s, i, *values in rows]
    for k in range(3):
        part = [(s, day(i), *values) for s, i, *values in rows if i // 10 == k]
        # A day the watermark has passed: dropped.
        part += [(1, day(3), 50.0, 1.0, 1.0)] if k == 2 else []
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.run_to_parquet(T.soiling_state_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    want = []
    for s in stations:
        eqd, ratio, last = 0.0, 1.0, None
        for _, i, rain, fine, coarse in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            rain, fine, coarse = rain or 0.0, 10.0 if fine is None else fine, coarse or 0.0
            last = day(i) if rain >= 10 else last
            eqd = (0.0 if rain >= 10 else 1.0 - (rain - 1.0) / 9.0 if rain >= 1 else 1.0 + 0.02 * max(0.0, coarse - 50.0)) * (eqd + 1.0)
            ratio = 1.0 if rain >= 1 else max(0.0, ratio - 0.0006 * fine)
            want += [(s, day(i), eqd, ratio, last)] if i < 28 else []
    order = lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, 0, r[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    state = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "cp"))
    # -1; 0 to 63; 64 to 99; no location; the far one.
    assert state.count() == 5


def test_days_are_made_and_joined_in_tasks_of_few_rows(spark, tables, monkeypatch):
    from panelspark import session
    from panelspark.plans import catalog
    from tests.conftest import SF

    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    rows = tables.lineitem.count()
    df = catalog.QUERIES["j01_weather_with_air_quality"](spark, SF)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 0.9 * rows / 300 and max(sizes) < 600
    # Each side is shuffled once; groups and the join take what the shuffle dealt.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["j01_weather_with_air_quality"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 == plan.count("REPARTITION_BY_NUM")


def test_disagreement_shuffles_shapes_once(spark, tables):
    from panelspark.plans.quality import disagreement

    plan = disagreement(tables)._jdf.queryExecution().executedPlan().toString()
    # No table is stored or numbered on the way, no side is joined with the other.
    assert plan.count("Exchange") == 1 and plan.count("Window") == 0 and plan.count("Join") == 0


def test_disagreement_of_one_pass_equals_that_of_joins(spark, monkeypatch):
    from panelspark.functions import geo as G
    from panelspark.operators import quality as Q

    rng = np.random.default_rng(6)
    # Tiles of one side only, crowded ones, a null tile; in each tile some shapes of three corners.
    p, kind = boxes(rng, [(1, 4), (2, 70), (4, 3), (None, 3), (5, 1)], "pred_idx")
    g, kind_g = boxes(rng, [(1, 3), (2, 80), (3, 2), (None, 2), (5, 1)], "gt_idx")

    def shapes(rows, kind, index):
        box = G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        ring = F.when(F.col(index) % 5 == 0, F.slice(box, 1, 3)).when(F.col(index) != 61, box)
        return spark.createDataFrame(rows, kind).withColumn("ring", ring)

    preds = shapes(p, kind, "pred_idx").withColumn("conf", F.when(F.col("pred_idx") == 7, float("nan")).when(F.col("pred_idx") != 8, 1 / F.col("pred_idx")))
    one = Q.label_disagreement(shapes(g, kind_g, "gt_idx"), preds)
    got = one.orderBy("tile_id").collect()
    monkeypatch.setattr(Q, "AT_ONCE", 50)
    assert [str(r) for r in one.orderBy("tile_id").collect()] == [str(r) for r in got]
    monkeypatch.setattr(Q, "LARGE", 0)
    joined = Q.label_disagreement(shapes(g, kind_g, "gt_idx"), preds)
    assert one.dtypes == joined.dtypes and [str(r) for r in joined.orderBy("tile_id").collect()] == [str(r) for r in got]
    assert [r.tile_id for r in got] == [None, 1, 2, 3, 4, 5]


def test_piled_blocks_are_swept_in_parts(monkeypatch):
    from panelspark.operators import quality as Q

    rng = np.random.default_rng(7)
    group, label = np.sort(rng.integers(0, 3, 60)), rng.random(60) < 0.5
    low = rng.integers(0, 40, (60, 2))
    high = low + rng.integers(1, 20, (60, 2))
    masks = np.zeros((3, 2, 70, 70), dtype=bool)
    for k, side, (x0, y0), (x1, y1) in zip(group, label, low, high):
        masks[k, int(side), y0:y1, x0:x1] = True
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(Q, "AT_ONCE", at_once)
        both, either = Q._swept(group, label, low[:, 1], high[:, 1], low[:, 0], high[:, 0], 3)
        assert both.tolist() == masks.all(axis=1).sum(axis=(1, 2)).tolist() and either.tolist() == masks.any(axis=1).sum(axis=(1, 2)).tolist()
