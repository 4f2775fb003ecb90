"""Signal preparation, sources, governance and frozen models on small inputs, with planted violations."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import folds as K
from barloom.operators import governance as G
from barloom.operators import metrics as M
from barloom.operators import ml
from barloom.operators import policy as S
from barloom.operators import signals as N
from barloom.operators import zigzag as Z
from barloom.sources import files as I

D1, D2 = dt.date(2021, 1, 1), dt.date(2021, 1, 2)


def locked(spark):
    rows = [(f"{s}::{d}", s, d, x) for d, xs in ((D1, (0.99, 0.90, 0.80)), (D2, (0.95, 0.85, 0.75))) for s, x in zip("ABC", xs)]
    return S.daily_top_fraction(spark.createDataFrame(rows, "event_id string, symbol string, d date, score double"))


def started(spark, *more):
    return spark.createDataFrame([("A", D1, 0.0), ("A", D2, 1.0), ("B", D1, 1.0), ("B", D2, 2.0), ("C", D1, 1.0), ("C", D2, 1.0), *more], "symbol string, d date, started double")


def test_filter_comes_before_the_new_ranking(spark):
    rows = N.with_started(locked(spark), started(spark))
    again = N.filter_then_rerank(rows, N.nonzero())
    got = {(r.event_id): (r.daily_rank, r.selected, r.locked_selected) for r in again.collect()}
    assert got[f"B::{D1}"] == (1, True, False) and f"A::{D1}" not in got and got[f"B::{D2}"] == (2, False, False) and len(got) == 5
    audit = {r.d: r for r in N.rerank_audit(rows, N.nonzero(), again).collect()}
    assert (audit[D1].locked_candidates, audit[D1].kept_candidates, audit[D1].signals, audit[D1].score_cutoff) == (3, 2, 1, 0.90)
    a = N.started_audit(rows).first()
    assert (a.started_equal_zero, a.started_nonzero, a.started_greater_than_one, a.maximum_started) == (1, 5, 1, 2)


@pytest.mark.parametrize("bad", [("C", D2, 1.0), None, 0.5])
def test_started_must_be_whole_and_single(spark, bad):
    t = started(spark, *([bad] if isinstance(bad, tuple) else []))
    if bad is None:
        t = t.filter("not (symbol = 'B' and d = '2021-01-02')")
    if bad == 0.5:
        t = t.withColumn("started", F.when(F.col("symbol") == "B", 0.5).otherwise(F.col("started")))
    with pytest.raises(ValueError):
        N.with_started(locked(spark), t).count()


def test_selected_signals(spark):
    picked = locked(spark).filter("selected").withColumn("selected", F.lit(" True"))
    assert N.selected_signals(picked, expected_rows=2, last_day=D2).count() == 2
    for broken, n, last in ((picked, 3, D2), (picked, 2, D1), (picked.withColumn("daily_rank", F.lit(2)), 2, D2), (picked.withColumn("selected", F.lit("false")), 2, D2), (picked.withColumn("event_id", F.lit("x")), 2, D2)):
        with pytest.raises(ValueError):
            N.selected_signals(broken, expected_rows=n, last_day=last)


def test_temporal_scope():
    good = {"unseen_test_start": "2021-01-01", "signal_generation_end": D2, "outcome_observation_tail_end": "2021-02-01"}
    assert N.temporal_scope({"temporal_scope": good})[1] == D2
    with pytest.raises(KeyError):
        N.temporal_scope({})
    with pytest.raises(KeyError):
        N.temporal_scope({"temporal_scope": {"unseen_test_start": D1}})
    with pytest.raises(ValueError):
        N.temporal_scope({"temporal_scope": good | {"signal_generation_end": "2020-12-31"}})


def test_warm_up_and_metadata(spark):
    train = spark.createDataFrame([("A", D1, 1.0), ("A", D2, 2.0)], "symbol string, d date, x double")
    test = spark.createDataFrame([("A", D2, 3.0), ("A", dt.date(2021, 1, 3), 4.0)], "symbol string, d date, x double")
    got = sorted((r.d, r.x, r.partition) for r in N.with_warm_up(train, test, D2).collect())
    assert got == [(D1, 1.0, "train"), (D2, 3.0, "unseen_test")]
    assert N.with_metadata(train, {"slippage": 0.1, "name": "s"}).first().name == "s"


def test_planted_violations_are_counted(spark):
    m = spark.createDataFrame([(1, "a", D1, D2, 1, "s", "train"), (1, "a", D1, D2, 1, "s", "validation"), (1, "b", D2, D2, 0, "s", "train")], "fold_id int, event_id string, d date, event_end_date date, meta_label int, symbol string, role string")
    m = m.withColumns({"train_end_date": F.lit(D1), "validation_start_date": F.lit(D2), "validation_end_date": F.lit(D2)})
    f = K.fold_integrity(m).first()
    assert (f.train_event_ids_in_validation, f.train_validation_event_start_date_overlap, f.train_start_after_train_end, f.train_event_end_on_or_after_validation_start, f.validation_before_validation_start) == (1, 1, 1, 2, 1)
    t = spark.createDataFrame([(0.1, 0.5), (0.2, 0.4), (0.3, 0.6)], "raw double, mapped double")
    assert M.non_decreasing(t, "raw", "mapped").first().violations == 1
    lock = locked(spark).select("event_id", "symbol", "d", "score", (F.col("symbol") == "C").alias("selected"))
    assert S.rerank_matches(lock, fraction=0.05).first().differing == 4
    oof = spark.createDataFrame([(1, "a", D1, 1, 0.5), (1, "a", D1, 1, 0.5), (1, "b", D2, 0, float("nan"))], "fold_id int, event_id string, d date, meta_label int, score double")
    a = N.oof_audit(oof).first()
    assert (a.duplicate_event_ids, a.nonfinite_scores, a.dates) == (1, 1, 2)


def test_prefix_invariance_finds_a_look_ahead(spark):
    bars = spark.createDataFrame([(1, D1 + dt.timedelta(i), i, float(i % 7)) for i in range(40)], "symbol long, d date, pos int, x double")
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("d")
    peek = Z.prefix_invariance(bars, [20], lambda t: t.withColumn("y", F.lead("x").over(w)), ["y"])
    causal = Z.prefix_invariance(bars, [20], lambda t: t.withColumn("y", F.lag("x").over(w)), ["y"])
    assert [r.same for r in peek.collect()] == [False] and [r.same for r in causal.collect()] == [True]


def test_audit_sample_is_the_same_every_time(spark):
    bars = spark.range(30).selectExpr("id as symbol").crossJoin(spark.range(100).selectExpr("cast(id as int) as pos"))
    a, b = ({(r.symbol, r.pos) for r in Z.audit_sample(bars).collect()} for _ in range(2))
    assert a == b and len(a) == 144 and len({s for s, _ in a}) == 12 and min(p for _, p in a) >= 64


def test_files(spark, tmp_path):
    (tmp_path / "bars").mkdir()
    for name in ("B.B_train.csv", "é.csv"):
        (tmp_path / "bars" / name).write_text("\ufeffd,x,unused\n20210102,1.5,a\nbad,n/a,b\n", encoding="utf-8")
    t = I.read_bars(spark, str(tmp_path / "bars"), ["d", "x", "absent"])
    assert t.columns == ["d", "x", "symbol", "ingest_ordinal"] and {r.symbol for r in t.collect()} == {"B.B", "é"}
    assert sorted(str(r.d) for r in I.read_prepared(spark, str(tmp_path / "bars")).collect()) == ["2021-01-02", "2021-01-02", "None", "None"]
    assert {r.symbol for r in I.file_map(spark, str(tmp_path / "bars"), I.SUFFIXES).collect()} == {"B.B", "é"}
    (tmp_path / "bars" / "B.B.csv").write_text("d\n")
    with pytest.raises(ValueError):
        I.file_map(spark, str(tmp_path / "bars"), I.SUFFIXES)
    assert I.first_path(tmp_path, ["none", "bars"]).name == "bars"
    with pytest.raises(FileNotFoundError):
        I.first_path(tmp_path, ["none"])
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert I.load_config(tmp_path / "c.json") == {"a": 1}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(TypeError):
        I.load_config(tmp_path / "l.json")
    out = str(tmp_path / "out")
    I.write_stage(t.select("symbol", "x"), out, by=["symbol"])
    I.write_stage(t.select("symbol", "x").limit(1), out, by=["symbol"])
    assert spark.read.parquet(out).count() == 1
    I.write_stage(t.select("symbol"), str(tmp_path / "csv"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["symbol"]


def test_sources_fall_back(spark):
    cols = "symbol string, x double"
    first, second = spark.createDataFrame([("A", 1.0), ("B", -1.0), ("B", 2.0)], cols), spark.createDataFrame([("A", 5.0), ("B", 6.0)], cols)
    rows, chosen, missing = I.resolve_sources([("one", first), ("two", second)], F.col("x") > 0, spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"))
    assert {(r.symbol, r.source) for r in chosen.collect()} == {("A", "one"), ("B", "two")} and {(r.symbol, r.x) for r in rows.collect()} == {("A", 1.0), ("B", 6.0)} and [r.symbol for r in missing.collect()] == ["C"]


def test_governance(spark, tmp_path):
    assert G.object_hash({"b": 1, "a": D1}) == G.object_hash({"a": D1, "b": 1}) != G.object_hash({"a": D1, "b": 2})
    (tmp_path / "f.txt").write_bytes(b"abc")
    f = G.file_hashes(spark, str(tmp_path / "f.txt")).first()
    assert f.length == 3 and f.sha256.startswith("ba7816bf")
    digest = G.write_manifest(tmp_path / "m" / "manifest.json", "stage", rows=3)
    import json

    body = json.loads((tmp_path / "m" / "manifest.json").read_text())
    assert body.pop("manifest_sha256") == digest == G.object_hash(body)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert G.fingerprint(t).first().digest == G.fingerprint(t.orderBy(F.desc("x"))).first().digest
    assert G.ordered_fingerprint(t, ["x"], ["x", "y"]).first().digest != G.ordered_fingerprint(t.withColumn("x", -F.col("x")), ["x"], ["y"]).first().digest


def test_models(spark, tmp_path):
    rows = [(f"e{i}", "s", D1 + dt.timedelta(i), D1 + dt.timedelta(i + 1), int(i % 3 == 0), float(i % 3), None if i % 5 == 0 else "uv"[i % 2], 1.0, 1 + i % 2, "train" if i < 40 else "validation") for i in range(60)]
    m = spark.createDataFrame(rows, "event_id string, symbol string, d date, event_end_date date, meta_label int, x double, c string, sample_weight double, fold_id int, role string")
    out, model = ml.fit_predict_fold(m, 1, "gbt", ["x"], ["c"], maxIter=3)
    assert out.count() == 10 and ml.fitted_feature_names(model)[:2] == ["x", "c_u"]
    fills = ml.fit_fills(m, ["x"], ["c"])
    lock = ml.frozen_scores(model, fills, m)
    assert lock.columns == list(G.LOCK_COLUMNS) and lock.count() == 60
    assert ml.save_checked(model, str(tmp_path / "model"), ml.apply_fills(m, fills), "event_id") == 0
    store = str(tmp_path / "study")
    some = ml.search(m, [1, 2], "gbt", ["x"], trials=2, store=store).count()
    seen = I.stored_trials(spark, store).count()
    whole = ml.search(m, [1, 2], "gbt", ["x"], trials=3, store=store)
    assert (some, seen, whole.count()) == (2, 2, 3) and {r.trial for r in I.stored_trials(spark, store).collect()} == {0, 1, 2}


def test_stages(spark, tmp_path):
    from barloom.operators import bars as B
    from barloom.plans import stages

    rows = [(s, D1 + dt.timedelta(i), i, 100.0 + i % 9, 103.0 + i % 9, 98.0 + i % 9, 101.0 + i % 9, 1e7) for s in (1, 2) for i in range(80)]
    bars = B.market_history(spark.createDataFrame(rows, "symbol long, d date, pos int, adj_open double, adj_high double, adj_low double, adj_last_price double, traded_value double").withColumn("vol", F.lit(1.0)))
    events = bars.filter("pos between 25 and 40").select(F.concat_ws("::", "symbol", "d").alias("event_id"), "symbol", "d", (F.col("pos") / 100.0).alias("score"))
    customers = spark.createDataFrame([(float(10_000 + i),) for i in range(20)], "v double")
    config = {"temporal_scope": {"unseen_test_start": D1, "signal_generation_end": "2021-02-05", "outcome_observation_tail_end": "2021-03-20"}}
    begun = bars.select("symbol", "d", (F.col("pos") % 4).cast("double").alias("started"))
    out = stages.filtered_portfolio_stage(bars, S.daily_top_fraction(events), begun, customers, "v", config, str(tmp_path / "run"), {"variant": "nonzero"}, slippages=("0bp",), structures=("single_lot",), exits=("trailing",))
    assert all("variant" in t.columns for t in out.values()) and out["trades"].count() > 0 and out["performance"].count() == 3
    assert {r.d for r in out["decisions"].select(F.col("signal_date").alias("d")).collect()} <= {r.d for r in events.filter("d <= '2021-02-05'").collect()}
    panel = events.withColumns({"meta_label": F.lit(1), "event_return": F.lit(0.1), "started": F.lit(1)})
    index = bars.groupBy("d").agg(F.avg("adj_last_price").alias("index_close"), F.avg("adj_low").alias("index_low"), F.avg("adj_high").alias("index_high"))
    breadth = stages.breadth_stage(bars, index, panel, 2, [2021])
    assert breadth["variants"].count() == 12 and breadth["yearly"].count() == 12 and breadth["pearson"].columns == breadth["spearman"].columns
