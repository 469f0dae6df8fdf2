import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest

from pressgauge.config import Settings
from pressgauge.operators import panel

TOPICS = ["alpha", "beta", "gamma"]
NAMES = [*TOPICS, "other_econ"]
CFG = Settings()


def make_rows():
    rng = random.Random(7)
    rows = []
    for region, weeks in {"one": range(14), "gap": [0, 1, 2, 5, 6, 9, 10, 11, 12, 13, 14, 15], "single": [3]}.items():
        for w in weeks:
            week = dt.date(2022, 1, 3) + dt.timedelta(weeks=w)
            for _ in range(rng.randrange(1, 9)):
                econ = rng.random() < 0.8
                topic = rng.choice(["alpha", "alpha", "beta", "other_econ"]) if econ else "unassigned"
                similarity = 0.5 if topic == "beta" else round(rng.uniform(0.4, 0.9), 4)
                rows.append((week, region, topic, econ, rng.choice([1.0, 0.5, 0.25]), similarity))
    return rows


ROWS = make_rows()
SCHEMA = "week date, region string, assigned_topic string, is_econ boolean, effective_weight double, top1_similarity double"


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def brute_force(rows, cfg):
    """The index by loops over dictionaries."""
    total, weight, similar = defaultdict(float), defaultdict(float), defaultdict(float)
    for week, region, topic, econ, w, s in rows:
        if econ:
            total[region, week] += w
            weight[region, week, topic] += w
            similar[region, week, topic] += w * s
    everything = sum(total.values()) * len(NAMES)
    prior = {t: sum(v for k, v in weight.items() if k[2] == t) / everything for t in NAMES}
    out = {}
    for region in {k[0] for k in total}:
        weeks = sorted(w for r, w in total if r == region)
        for t in NAMES:
            seen, run = [], 0
            for week in weeks:
                n, all_ = weight[region, week, t], total[region, week]
                p = (n + prior[t] * 20) / (all_ + 20)
                base = statistics.fmean(seen[-8:]) if len(seen) >= 3 else prior[t]
                recent = statistics.fmean(seen[-4:]) if len(seen) >= 2 else base
                run = run + 1 if round(p - base, 12) > 0 else 0
                out[region, week, t] = {
                    "n_articles": n, "total_econ_weight": all_, "topic_share": n / all_,
                    "mean_similarity": similar[region, week, t] / n if n else 0.0,
                    "baseline_share": base, "surprise": p - base, "momentum": p - recent, "persistence_weeks": run,
                }
                seen.append(p)
    for t in NAMES:
        cells = [c for k, c in out.items() if k[2] == t]
        z = {}
        for name in ("surprise", "momentum", "mean_similarity"):
            mean, std = statistics.fmean(c[name] for c in cells), statistics.pstdev([c[name] for c in cells])
            z[name] = lambda x, mean=mean, std=std: max(-3.0, min(3.0, (x - mean) / std)) if std > 0 else 0.0
        for c in cells:
            support = (c["total_econ_weight"] / (c["total_econ_weight"] + 5)) ** 0.5
            c["risk_score"] = support * (
                0.5 * z["surprise"](c["surprise"]) + 0.3 * z["momentum"](c["momentum"])
                + 0.2 * z["mean_similarity"](c["mean_similarity"])
            )
    return out


def test_index_equals_brute_force(scored):
    got = {(r.region, r.week, r.topic): r.asDict() for r in panel.build_index(scored, CFG, TOPICS).collect()}
    expected = brute_force(ROWS, CFG)
    assert set(got) == set(expected)
    for key, cell in expected.items():
        for name, value in cell.items():
            assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)


def test_panel_invariants(scored):
    full = panel.full_panel(scored, NAMES, CFG).collect()
    by_week = defaultdict(list)
    for r in full:
        by_week[r.region, r.week].append(r)
    for cells in by_week.values():
        assert len(cells) == len(NAMES)
        assert sum(c.topic_share for c in cells) == pytest.approx(1.0)
    assert all((r.persistence_weeks > 0) == (round(r.surprise, 12) > 0) for r in full)
    assert all(0 < r.support < 1 for r in full)
    # a topic that never occurs has no spread, so its scores are zero
    assert {r.risk_score for r in full if r.topic == "gamma"} == {0.0}


def test_first_weeks_use_the_prior(scored):
    full = panel.full_panel(scored, NAMES, CFG)
    single = full.where("region = 'single'").collect()
    assert all(r.baseline_share == r.topic_prior == r.recent_share for r in single)


def test_prior_modes(scored):
    dense = panel.dense_panel(scored, NAMES)
    total = lambda mode: sum(r.topic_prior for r in panel.topic_prior(dense, NAMES, mode).collect())
    assert total("per_panel_row") == pytest.approx(1 / len(NAMES))
    assert total("per_region_week") == pytest.approx(1.0)


def test_runs(spark):
    values = [0.1, 0.2, -0.1, 0.3, 0.0, 1e-15]
    rows = [("r", "t", dt.date(2022, 1, 3) + dt.timedelta(weeks=i), v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "region string, topic string, week date, surprise double")
    got = panel.with_persistence(frame).orderBy("week").collect()
    assert [r.persistence_weeks for r in got] == [1, 2, 0, 1, 0, 0]


def test_cells_agree_with_the_wide_form(scored):
    cells = {(r.week, r.region, r.topic): r.n_articles for r in panel.topic_cells(scored).collect()}
    dense = {(r.week, r.region, r.topic): r.n_articles for r in panel.dense_panel(scored, NAMES).collect()}
    assert {k: v for k, v in dense.items() if v > 0} == pytest.approx(cells)
