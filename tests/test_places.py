"""Places along an order, selection of many positions at once, quantiles per group, DBSCAN on many clumped rows."""

import numpy as np
import pytest

from shelfwise.operators import cluster, density, encode, places, quantiles


def test_codes_of_a_common_prefix_spread_over_tasks(spark):
    words = sorted({f"common prefix {i * 7919 % 100_003}" for i in range(6000)})
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "v string")
    codes = encode.ordinal_codes(df, "v")
    got = {r["value"]: r["code"] for r in codes.collect()}
    assert got == {w: i for i, w in enumerate(sorted([*words, encode.UNKNOWN]))}
    ranges = places._ranged(df.distinct(), ["v"]).groupBy(places._PART).count().collect()
    assert len(ranges) > 3 and max(r["count"] for r in ranges) < len(words) / 2


def test_earlier_sums(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(1000)], "k int, n int")
    rows = places.earlier_sums(df, ["k"], "n", "before").orderBy("k").collect()
    assert [r["before"] for r in rows] == [sum(i % 5 for i in range(k)) for k in range(1000)]
    assert places.earlier_sums(df.limit(0), ["k"], "n", "before").count() == 0


@pytest.mark.parametrize("small", [20, 100_000])
def test_all_positions_share_their_passes(spark, small, monkeypatch):
    """Thirty positions in three columns, found in as many aggregates as one."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=3000), np.round(rng.exponential(size=3000), 1), rng.integers(0, 3, 3000) * 1.0])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").persist()
    calls, plain = [], type(df).agg
    monkeypatch.setattr(quantiles, "ACCURACY", 50)  # coarse sketches, so that several levels are needed
    monkeypatch.setattr(type(df), "agg", lambda self, *e: calls.append(1) or plain(self, *e))
    counts = {}
    for fractions in ([0.37], [i / 9 for i in range(10)]):
        calls.clear()
        got = quantiles.quantiles(df, {n: fractions for n in "abc"}, small=small)
        counts[len(fractions)] = len(calls)
        for j, n in enumerate("abc"):
            assert [got[n][q] for q in fractions] == pytest.approx(np.quantile(x[:, j], fractions).tolist(), abs=1e-12)
    assert counts[10] <= counts[1] + 4 and (small > 3000 or counts[1] > 2)
    df.unpersist()


def test_quantiles_per_group_with_one_hot_group(spark):
    rng = np.random.default_rng(4)
    groups = {"hot": np.round(rng.normal(size=4000), 2), "one": np.array([3.5]), None: rng.integers(0, 4, 50) * 1.0, "": rng.normal(size=7)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in quantiles.grouped_quantiles(df, "g", "v", fractions).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        r = got[g]
        assert r["n"] == len(values) and r["minimum"] == values.min() and r["maximum"] == values.max()
        assert r["q"] == pytest.approx(np.quantile(values, fractions).tolist(), abs=1e-12)
    assert quantiles.grouped_quantiles(df.limit(0), "g", "v", [0.5]).count() == 0


def test_sampled_silhouette_on_all_rows(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(150, 2)), rng.integers(0, 3, 150)
    c[0] = 7  # alone in its cluster
    df = spark.createDataFrame([(f"u{i}", *map(float, p), int(k)) for i, (p, k) in enumerate(zip(x, c))], "uid string, a double, b double, k int")
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    value = []
    for i in range(150):
        own = c == c[i]
        if own.sum() == 1:
            value.append(0.0)
            continue
        a = away[i, own].sum() / (own.sum() - 1)
        b = min(away[i, c == k].mean() for k in set(c) - {c[i]})
        value.append((b - a) / max(a, b))
    assert cluster.sampled_silhouette(df, "k", ("a", "b")) == (150, pytest.approx(np.mean(value)))
    assert cluster.sampled_silhouette(df, "k", ("a", "b"), size=40)[0] == 40
    assert cluster.sampled_silhouette(df.limit(0), "k", ("a", "b")) == (0, 0.0)


def test_dbscan_on_many_copies_of_clumped_vectors(spark):
    """Core, border and noise of 17,000 rows against brute force; most are copies of a few of 1,160 vectors."""
    rng = np.random.default_rng(6)
    centres = rng.uniform(0, 2, (8, 3))
    x = np.concatenate([c + rng.normal(0, rng.uniform(0.02, 0.2), (120, 3)) for c in centres] + [rng.uniform(-1, 3, (200, 3))])
    copies = np.concatenate([np.repeat(x[:3], 4000, axis=0), np.repeat(x[-20:], 200, axis=0)])
    rows = np.concatenate([x, copies])
    weight = np.ones(len(x))
    weight[:3] += 4000
    weight[-20:] += 200
    eps, least = 0.15, 5
    near = np.zeros((len(x), len(x)), bool)
    for at in range(0, len(x), 500):
        near[at : at + 500] = ((x[at : at + 500, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near @ weight >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        front = np.zeros(len(x), bool)
        front[i] = True
        while front.any():
            label[front] = i
            front = near[front].any(0) & core & (label < 0)
    df = spark.createDataFrame([(f"u{i}", *map(float, r)) for i, r in enumerate(rows)], "uid string, a double, b double, c double")
    got = {r["uid"]: r["cluster_dbscan"] for r in density.dbscan(df, ("a", "b", "c"), eps, least).select("uid", "cluster_dbscan").collect()}
    assert len(rows) > 17_000 and len(got) == len(rows)
    found = np.array([got[f"u{i}"] for i in range(len(x))])
    pairs = set(zip(label[core].tolist(), found[core].tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 2
    to_found = dict(pairs)
    touched = near & core
    for i in np.flatnonzero(~core):
        assert found[i] == min((to_found[k] for k in label[touched[i]]), default=-1)
    for k in range(12000):
        assert got[f"u{len(x) + k}"] == found[k // 4000]


def test_dbscan_keeps_no_copy_of_all_rows(spark, monkeypatch):
    """What is written on the way grows with cells and doubtful rows, not with the rows of dense cells."""
    rng = np.random.default_rng(3)
    clumps = np.concatenate([c + rng.uniform(-0.01, 0.01, (600, 2)) for c in ([0.1, 0.1], [0.9, 0.2], [0.5, 0.8])])
    x = np.concatenate([clumps, rng.uniform(2, 9, (20, 2))])
    df = spark.createDataFrame([(f"u{i}", *map(float, p)) for i, p in enumerate(x)], "uid string, a double, b double")
    sizes, written = [], density.materialise

    def counted(table):
        made = written(table)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(density, "materialise", counted)
    got = {r["uid"]: r["cluster_dbscan"] for r in density.dbscan(df, ("a", "b")).collect()}
    assert len(sizes) > 5 and max(sizes) < 300
    assert [len({got[f"u{i}"] for i in range(at, at + 600)}) for at in (0, 600, 1200)] == [1, 1, 1]
    assert {got[f"u{i}"] for i in range(1800)} == {0, 1, 2} and {got[f"u{i}"] for i in range(1800, 1820)} == {-1}
