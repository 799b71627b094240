import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import ordering, statistics


@pytest.fixture(autouse=True, params=["true", "false"], ids=["merged ranges", "all ranges"])
def coalescing(spark, request):
    """Ranges as adaptive execution merges them, and as many as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups, one of which holds most rows, with many ties."""
    rng = np.random.default_rng(3)
    sizes = {"hot": 3000, "small": 40, "one": 1, None: 25}
    rows = [(g, float(np.round(rng.normal(0, 5), 1))) for g, n in sizes.items() for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("bounded", [False, True])
def test_grouped_quantiles_match_numpy(skewed, bounded):
    rows, df = skewed
    probs = {"p10": 0.1, "q1": 0.25, "median": 0.5, "p99": 0.99}
    got = {r.g: r for r in ordering.quantiles(df, "v", probs, by=["g"], bounded=bounded).collect()}
    for g in ("hot", "small", "one", None):
        values = [v for h, v in rows if h == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_global_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (4.0,)], "v double")
    row = ordering.quantiles(df, "v", {"m": 0.5, "q": 0.25}).first()
    assert (row.m, row.q) == (2.0, 1.5)


def test_running_totals_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 50, 2000))]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    got = ordering.running_totals(df, [F.desc("v"), F.col("id")], {"v": "upto"}).collect()
    expected, total = {}, 0
    for i, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += v
        expected[i] = total
    assert {r.id: r.upto for r in got} == expected
    assert {r.upto_total for r in got} == {total}


def test_ranges_are_really_split(spark, coalescing):
    """The unmerged setting must exercise several ranges, or the tests above prove little."""
    from orderloom.session import checkpointed
    df = spark.range(2000).repartitionByRange("id").withColumn("p", F.spark_partition_id())
    parts = checkpointed(df).groupBy("p").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("p").collect()
    assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]))
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false":
        assert len(parts) > 1


def average_rank(values):
    order = sorted(values)
    first = {}
    count = {}
    for i, v in enumerate(order, 1):
        first.setdefault(v, i)
        count[v] = count.get(v, 0) + 1
    return np.array([first[v] + (count[v] - 1) / 2 for v in values])


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    delay = np.round(rng.normal(0, 6, 800))
    score = np.clip(np.round(4 - delay / 6 + rng.normal(0, 1, 800)), 1, 5).astype(int)
    group = rng.integers(0, 4, 800)
    rows = [(float(d), int(s), bool(d <= 0), int(g)) for d, s, g in zip(delay, score, group)]
    return rows, spark.createDataFrame(rows, "delay double, score int, early boolean, g int")


def test_spearman_matches_ranks(scored):
    rows, df = scored
    got = statistics.spearman_set(df, {"a": ("delay", "score")}).first()
    expected = np.corrcoef(average_rank([r[0] for r in rows]), average_rank([r[1] for r in rows]))[0, 1]
    assert got.rho == pytest.approx(expected, abs=1e-12) and got.n == len(rows)


def test_mannwhitney_matches_pair_count(scored):
    rows, df = scored
    got = statistics.mannwhitney(df, "early", "score").first()
    first = [r[1] for r in rows if r[2]]
    second = [r[1] for r in rows if not r[2]]
    expected = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    assert got.u == pytest.approx(expected) and (got.n1, got.n2) == (len(first), len(second))


def test_kruskal_matches_formula(scored):
    rows, df = scored
    ranks = average_rank([r[1] for r in rows])
    n = len(rows)
    h = 12 / (n * (n + 1)) * sum(
        ranks[[r[3] == g for r in rows]].sum() ** 2 / sum(r[3] == g for r in rows) for g in range(4)) - 3 * (n + 1)
    ties = sum(t ** 3 - t for t in np.unique([r[1] for r in rows], return_counts=True)[1])
    got = statistics.kruskal(df, "g", "score").first()
    assert got.h == pytest.approx(h / (1 - ties / (n ** 3 - n)), rel=1e-9) and got.n_groups == 4


def test_logit_matches_newton(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-(-0.5 + 0.8 * x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    got = {r.predictor: r for r in statistics.logit_negative_review(df, ["a", "b"], "y").collect()}
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    for name, value in zip(("a", "b", "const"), beta):
        assert got[name].coef == pytest.approx(value, abs=1e-6)
        assert got[name].odds_ratio == pytest.approx(np.exp(value), rel=1e-6)
    p = 1 / (1 + np.exp(-design @ beta))
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    base = y.mean()
    null = len(y) * (base * np.log(base) + (1 - base) * np.log(1 - base))
    assert got["a"].pseudo_r2 == pytest.approx(1 - ll / null, abs=1e-6)
    assert got["a"].n_obs == 1500
