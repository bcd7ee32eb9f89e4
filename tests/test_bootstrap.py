"""Bootstrap from cells and buckets (A13) against item-level resampling."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import bootstrap as BT
from labelweave.operators import scoring as SC


def draws(spark, cells, B, seed=1):
    df = spark.createDataFrame([("m", "x", cells)], "model string, metric string, cells array<bigint>")
    got = BT.resample_cells(df, B, seed, ["model", "metric"]).select("b", "draws").collect()
    assert sorted(r.b for r in got) == list(range(B))
    return np.array([r.draws for r in got])


@pytest.mark.parametrize("cells", [[3, 0, 5, 2], [40, 10, 900, 50, 0], [500_000_000, 300_000_000, 7, 200_000_000, 1_000_000]])
def test_cells_are_drawn_like_a_multinomial(spark, cells):
    """Means, variances and covariances of 4,000 draws; a draw keeps the number of items."""
    got = draws(spark, cells, 4000)
    n, p = sum(cells), np.array(cells) / sum(cells)
    assert (got.sum(1) == n).all() and (got >= 0).all() and (got[:, np.array(cells) == 0] == 0).all()
    sd = np.sqrt(n * p * (1 - p))
    assert (abs(got.mean(0) - n * p) <= 4.5 * sd / math.sqrt(4000) + 1e-9).all()
    assert (abs(got.std(0) - sd) <= 0.06 * sd + 1e-9).all()
    want = -n * p[0] * p[2]
    assert abs(np.cov(got[:, 0], got[:, 2])[0, 1] - want) <= 0.08 * sd[0] * sd[2]


def test_no_cells_and_no_items(spark):
    assert (draws(spark, [0, 0, 0], 5) == 0).all()
    df = spark.createDataFrame([], "model string, metric string, cells array<bigint>")
    assert BT.resample_cells(df, 3, 0, ["model", "metric"]).count() == 0


def test_small_binomial_is_exact(spark):
    """Draws of Binomial(3, 0.3): frequencies of the four outcomes."""
    got = draws(spark, [3, 7], 4000)[:, 0]
    # given 10 items, the first cell is Binomial(10, 0.3)
    want = np.array([math.comb(10, k) * 0.3 ** k * 0.7 ** (10 - k) for k in range(11)])
    seen = np.bincount(got, minlength=11) / 4000
    assert (abs(seen - want) <= 4.5 * np.sqrt(want * (1 - want) / 4000) + 1e-3).all()


def test_buckets_weigh_like_poisson(spark):
    sums = spark.range(BT.BUCKETS).selectExpr("CAST(id AS INT) AS bucket", "'m' AS model", "1 AS n")
    w = BT.resample_buckets(sums, 102, "s")
    r = w.agg(F.sum("w"), F.count("*"), F.max("b"), F.count_distinct("b")).first()
    total = BT.BUCKETS * 102
    assert abs(r[0] / total - 1) < 0.01 and abs(r[1] / total - (1 - math.exp(-1))) < 0.01 and (r[2], r[3]) == (101, 102)


def items(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    g = np.round(rng.uniform(-1, 1, n), 2)
    p = np.clip(np.round(g + rng.normal(0, 0.4, n), 2), -1, 1)
    gy, py = rng.random(n) < 0.3, None
    py = np.where(rng.random(n) < 0.85, gy, ~gy)
    return g, p, gy, py


def exact(g, p, gy, py, B=3000):
    """Item-level resampling with replacement in numpy."""
    rng = np.random.default_rng(9)

    def f1(a, b):
        tp, fp, fn = (a & b).sum(), (~a & b).sum(), (a & ~b).sum()
        return 2 * tp / (2 * tp + fp + fn)

    out = {"stance_R2": [], "stance_pos_F1": [], "ch_sensitive_F": []}
    for _ in range(B):
        i = rng.integers(0, len(g), len(g))
        out["stance_R2"].append(1 - ((g[i] - p[i]) ** 2).sum() / ((g[i] - g[i].mean()) ** 2).sum())
        out["stance_pos_F1"].append(f1(g[i] > 0, p[i] > 0))
        out["ch_sensitive_F"].append(f1(gy[i], py[i]))
    return {k: np.quantile(v, [0.025, 0.975]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    g, p, gy, py = items()
    yn = lambda x: "yes" if x else "no"
    rows = [(str(i), {"china_stance_score": str(a), "china_sensitive": yn(c), "collective_action": "no"},
             {"china_stance_score": str(b), "china_sensitive": yn(d), "collective_action": "no"})
            for i, (a, b, c, d) in enumerate(zip(g.tolist(), p.tolist(), gy.tolist(), py.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "meta_id string, gold map<string,string>, json map<string,string>").cache()
    return df.select("meta_id", "gold"), df.select(F.lit("m").alias("model"), "meta_id", F.lit(True).alias("parsed"), "json")


def test_intervals_match_item_resampling(spark, tables):
    """Both ends within the Monte-Carlo error of item-level resampling (a tenth of the interval's width)."""
    want = exact(*items())
    got = {r.metric: r for r in BT.bootstrap_standard(*tables, ["m"], B=2000, seed=11).collect()}
    for metric, (low, high) in want.items():
        r = got[metric]
        assert r.ci_low < r.score < r.ci_high
        assert max(abs(r.ci_low - low), abs(r.ci_high - high)) < 0.1 * (high - low), (metric, r, low, high)
    assert got["col_action_F"].score == got["col_action_F"].ci_high == 0.0


def test_no_row_per_item_and_replicate(spark, tables):
    """Replicates are made from cells and buckets: their number of rows is the same for any number of items."""
    sizes = []
    for part in ("true", "meta_id % 3 = 0"):
        cols = SC.standard_columns(SC.align(tables[0].filter(part), tables[1], ["m"]))
        cells, sums = BT.standard_sums(cols)
        assert cells.count() == 4 and sums.count() <= BT.BUCKETS
        assert cells.agg(F.sum(F.expr("aggregate(cells, 0L, (a, c) -> a + c)"))).first()[0] == 4 * cols.count()
        sizes.append(BT.resample_cells(cells, 40, 1, ["model", "metric"]).count())
        assert BT.resample_buckets(sums, 40, 1).count() <= 40 * sums.count()
    assert sizes == [4 * 40] * 2


def test_same_draws_on_any_partitioning(spark, tables):
    gold, preds = tables
    seen = []
    for parts in (1, 9):
        rows = BT.bootstrap_standard(gold.repartition(parts), preds.repartition(parts + 2), ["m"], B=60, seed="s").collect()
        seen.append(sorted((r.metric, round(r.ci_low, 9), round(r.ci_high, 9)) for r in rows))
    assert seen[0] == seen[1]


def test_constant_gold_and_few_pairs(spark):
    rows = [(str(i), {"china_stance_score": "0.5", "china_sensitive": "no"}, {"china_stance_score": v, "china_sensitive": "no"})
            for i, v in enumerate(["0.5", "0.5", "0.5"])]
    df = spark.createDataFrame(rows, "meta_id string, gold map<string,string>, json map<string,string>")
    preds = df.selectExpr("'m' AS model", "meta_id", "true AS parsed", "json")
    got = {r.metric: r for r in BT.bootstrap_standard(df.select("meta_id", "gold"), preds, ["m"], B=50).collect()}
    assert got["stance_R2"].score == got["stance_R2"].ci_low == got["stance_R2"].ci_high == 1.0
    assert got["col_action_F"].score is None and got["col_action_F"].ci_low is None
    none = BT.bootstrap_standard(df.filter("false").select("meta_id", "gold"), preds.filter("false"), ["m"], B=5)
    assert none.count() == 0


def test_no_pairs_at_all(spark):
    """R2 of a metric that no record has: no score, no interval, no error."""
    rows = [(str(i), {"china_stance_score": "x"}, {"china_stance_score": "0.5"}) for i in range(5)]
    df = spark.createDataFrame(rows, "meta_id string, gold map<string,string>, json map<string,string>")
    preds = df.selectExpr("'m' AS model", "meta_id", "true AS parsed", "json")
    got = BT.bootstrap_standard(df.select("meta_id", "gold"), preds, ["m"], B=20, yn_metric="r2").collect()
    assert {r.metric for r in got} == set(SC.STANDARD_R2_METRICS)
    assert all(r.score is None and r.ci_low is None for r in got if r.metric.endswith("R2"))
