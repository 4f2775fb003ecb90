"""Models on panels against the frames and MLlib: features, members, scores, and what is written on the way."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ml, oof
from barloom.operators import panel as N
from barloom.plans import portfolio
from barloom.plans import views as V
from barloom.plans.catalog import QUERIES

NAMES = (portfolio._NUMERIC, portfolio._CATEGORICAL)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of symbols 1 to 7, one with few bars, one without tax on some days, one without a supplier; some days have two bars at most."""
    path, r = tmp_path_factory.mktemp("lines"), random.Random(11)
    start = dt.datetime(1997, 1, 1)
    lines = []
    for s, days in ((1, 700), (2, 620), (3, 25), (7, 700), (None, 300)):
        for i in range(0, days, 2):
            for _ in range(r.choice((1, 1, 2, 3))):
                lines.append((s, start + dt.timedelta(days=i), float(r.randint(1, 50)), r.choice((0.0, 0.01, 0.05, 0.06, 0.1)), None if s == 2 and i % 90 == 0 else r.randint(0, 8) / 100, r.choice("RAN"), r.choice("OF")))
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.fixture(scope="module")
def study(spark, tables):
    return oof.study(V.table(spark, tables, "lineitem"), portfolio._FOLDS)


@pytest.fixture(scope="module")
def rows(spark, tables):
    return ml.event_rows(portfolio._fold_members(spark, tables), V.feature_frame(spark, tables), portfolio._FOLDS, *NAMES).cache()


def same(a, b) -> bool:
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12))


def test_panels_have_the_features_and_members_of_the_frames(study, rows):
    want = {(r.symbol, r.d): r for r in rows.collect()}
    sums, met = {k: [] for k in portfolio._FOLDS}, 0
    for r in study.chunks.collect():
        p, u, v, x, state, day = oof._panel(study, N.unpack(bytes(r.v)))
        market, sym, none = oof._market(study, day), np.repeat(p.sym, p.size), np.repeat(p.none, p.size)
        for i in np.flatnonzero((v > 0) | ~np.isnan(u).all(0)):
            w = want[None if none[i] else int(sym[i]), oof._EPOCH + dt.timedelta(days=int(p.d[i]))]
            met += 1
            got = {c: x[j, i] for j, c in enumerate(N.STOCK)} | {c: market[j, i] for j, c in enumerate(oof.P.MARKET_FEATURES)}
            for c, value in got.items():
                assert same(None if np.isnan(value) else value, w[c]), (c, value, w[c], w.symbol, w.d)
            assert (None if state[i] == N.NO_STATE else N.STATES[state[i]]) == w.gmma_state
            assert p.y[i] == w.meta_label and oof._EPOCH + dt.timedelta(days=int(p.ended[i])) == w.event_end_date
            assert v[i] == max([k for k in portfolio._FOLDS if w[f"v_{k}"]], default=0)
            for k in portfolio._FOLDS:
                assert np.isnan(u[k - 1, i]) == (w[f"w_{k}"] is None)
                if w[f"w_{k}"] is not None:
                    sums[k].append((u[k - 1, i], w[f"w_{k}"]))
    assert met == len(want)
    for pairs in sums.values():
        mean = sum(a for a, _ in pairs) / len(pairs)
        assert all(a / mean == pytest.approx(b, rel=1e-9) for a, b in pairs)


def test_a_forest_without_chance_is_mllibs_tree(study, rows):
    """Nothing drawn and all features tried: each of its trees is MLlib's single tree."""
    got = {(r.event_id, r.fold_id): r.p for r in oof.forest(oof.coded(study), trees=2, bagged=False, subset=1000).collect()}
    for k in (1, 5):
        of = ml.fold_rows_of(rows, k, *NAMES)
        want = ml.fit_predict_fold(of, k, "forest", *NAMES, numTrees=1, bootstrap=False, featureSubsetStrategy="all")[0].select("event_id", "p").collect()
        assert want and all(got[r.event_id, k] == pytest.approx(r.p, abs=1e-9) for r in want)


def test_bagged_forest_stays_near_mllibs(study, rows):
    t = oof.forest(oof.coded(study))
    assert t.dtypes == [("event_id", "string"), ("fold_id", "int"), ("meta_label", "int"), ("p", "double")]
    got = {(r.event_id, r.fold_id): (r.p, r.meta_label) for r in t.collect()}
    assert len(got) == rows.filter(" or ".join(f"v_{k}" for k in portfolio._FOLDS)).count()
    want = ml.fit_predict_fold(ml.fold_rows_of(rows, 5, *NAMES), 5, "forest", *NAMES)[0].select("event_id", "meta_label", "p").collect()
    assert all(got[r.event_id, 5][1] == r.meta_label for r in want)
    assert np.corrcoef([got[r.event_id, 5][0] for r in want], [r.p for r in want])[0, 1] > 0.7


def test_bags_are_poisson():
    n = oof._bag(np.random.Generator(np.random.SFC64(3)), 400_000, *oof._poisson_table())
    assert n.mean() == pytest.approx(1, abs=0.01) and n.var() == pytest.approx(1, abs=0.02) and (n == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_drawn_candidates_and_exact_medians(study, tables, spark, monkeypatch):
    """With more rows than suggest candidates, medians are still those of all rows."""
    monkeypatch.setattr(oof, "CANDIDATE_ROWS", 150)
    s = oof.study(V.table(spark, tables, "lineitem"), portfolio._FOLDS)
    assert not s.whole and study.whole and s.sample["x"].shape[1] < study.sample["x"].shape[1]
    g = oof.coded(s)
    oof.exact_moments(s)
    assert s.fill == pytest.approx(study.fill, rel=1e-12, abs=1e-15)
    for k in range(len(s.ids)):  # the byte for missing values leads to the bin of the median
        for j, f in enumerate(oof._S):
            r = s.sample["x"][j]
            assert 0 <= g.stock[k, j, 255] <= g.cuts[k][f] and len(r)
    assert oof.forest(g, trees=3).count() == oof.forest(oof.coded(study), trees=3).count()


def _written(spark, query, tables, tmp_path):
    """Bytes that a query leaves in the checkpoint folder."""
    sc, was = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    QUERIES[query](spark, tables).count()
    if was:
        sc.setCheckpointDir(was)
    return sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())


def test_forest_writes_no_features_as_doubles(spark, rows, tables, tmp_path):
    """Once 33 doubles an event lay in the folder, beside the events themselves; few events have room for a file's own size here."""
    assert _written(spark, "forest_oof", tables, tmp_path) < rows.count() * 33 * 8


def test_boosted_trees_are_mllibs(study, rows, spark, tables, tmp_path):
    got = {(r.event_id, r.fold_id): r.p for r in oof.boosted(oof.coded(study)).collect()}
    for k in (1, 5):
        want = ml.fit_predict_fold(ml.fold_rows_of(rows, k, *NAMES), k, "gbt", *NAMES)[0].select("event_id", "p").collect()
        assert want and all(got[r.event_id, k] == pytest.approx(r.p, abs=1e-9) for r in want)
    assert _written(spark, "gbt_oof", tables, tmp_path) < rows.count() * 33 * 8


def test_logistic_fit_is_mllibs_minimum(study, rows, monkeypatch, spark, tables, tmp_path):
    """MLlib's own tolerance ends before its minimum; with a finer one it meets the Newton steps."""
    lr = ml.LogisticRegression
    monkeypatch.setattr(ml, "LogisticRegression", lambda **a: lr(**(a | {"tol": 1e-13, "maxIter": 2000})))
    got = {(r.event_id, r.fold_id): r.p for r in oof.logistic(study).collect()}
    for k in (1, 5):
        want = ml.fit_predict_fold(ml.fold_rows_of(rows, k, *NAMES), k, "logistic", *NAMES)[0].select("event_id", "p").collect()
        assert want and all(got[r.event_id, k] == pytest.approx(r.p, abs=1e-5) for r in want)
    assert _written(spark, "logistic_baseline", tables, tmp_path) < rows.count() * 33 * 8
