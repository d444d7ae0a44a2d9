import numpy as np
import pyarrow.parquet as pq
import pytest

from lateloom.llm import topk_search


def brute(rows, k, every):
    ok = [(i, np.array([int(x) for x in np.floor(np.array(v, np.float64) * 64)], object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = max((len(x) for _, x in ok), default=0)
    ok = [(i, np.append(x, [0] * (wide - len(x)))) for i, x in ok]
    out = set()
    for i, x in ok:
        if i % every == 0:
            best = sorted((-int((x * y).sum()), j) for j, y in ok if j != i)[:k]
            out |= {(i, r + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(best)}
    return out


def found(df):
    rows = df.collect()
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def test_given_vectors(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    assert found(topk_search.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"))) == brute(rows, 20, 20)


@pytest.mark.parametrize("bucket", [7, 2048])
def test_odd_vectors(spark, bucket, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", bucket)
    monkeypatch.setattr(topk_search, "BLOCK", 5)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 30])).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 0.5, 0.25]) for i in range(60)] + [(400, None), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf"), 0.0]), (None, [1.0]), (480, []), (500, [0.0] * 6), (520, [1e6, -1e6, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, key int, score int, cell int")
    assert found(topk_search.top_k(df, k=9)) == brute(rows, 9, 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert found(topk_search.top_k(df)) == brute([(0, [1.0]), (20, [2.0]), (3, [1.0])], 20, 20)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_high_thresholds_prune_by_coordinates():
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal(size=(500, 8)) * 50).astype(np.int64)
    x[100:200] = x[0] + rng.integers(-3, 4, (100, 8))
    pack = topk_search._Pack(np.arange(500), x, np.sqrt((x.astype(float) ** 2).sum(1)))
    lists = topk_search.Lists(500, 3)
    for _ in range(2):  # the second time with full lists
        topk_search.search_bucket(lists, pack, pack, topk_search._focus(pack))
        lists.row, lists.id, lists.score = (a[:0] for a in (lists.row, lists.id, lists.score))
    topk_search.search_bucket(lists, pack, pack, topk_search._focus(pack))
    s = x @ x.T
    for i in range(500):
        best = sorted((-s[i, j], j) for j in range(500) if j != i)[:3]
        assert [(-int(a), int(b)) for a, b in zip(lists.score[lists.row == i], lists.id[lists.row == i], strict=True)] == best


def test_dominant_components():
    """Queries nearer to an axis than the threshold: vectors between query and axis, and beyond the axis, are found."""
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(size=(400, 8)) * 6).astype(np.int64)
    x[:200, 0] += 150
    x[200:, 3] -= 150
    x[0] = [150, 0, 0, 0, 0, 0, 0, 0]
    pack = topk_search._Pack(np.arange(400), x, np.sqrt((x.astype(float) ** 2).sum(1)))
    s = x @ x.T
    for k in (1, 20, 100):
        lists = topk_search.Lists(400, k)
        lists.least = np.array([sorted(np.delete(s[i], i))[-k] for i in range(400)], float)  # as found before
        topk_search.search_bucket(lists, pack, pack, topk_search._focus(pack))
        for i in range(400):
            best = sorted((-s[i, j], j) for j in range(400) if j != i)[:k]
            assert [(-int(a), int(b)) for a, b in zip(lists.score[lists.row == i], lists.id[lists.row == i], strict=True)] == best


@pytest.mark.parametrize("large", [1e13, 1e17, 1e200, 1e307])
def test_wide_components_are_exact(spark, large):
    """Products beyond 53, 63 and 1024 bits."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.rint(rng.normal(size=3) * 8) * large / (64 * 8)).tolist()) for i in range(45)] + [(45 + i, [1.0, 2.0, float(i)]) for i in range(20)]
    rows += [(66, rows[0][1]), (67, [1.7e308, 0.0, 0.0])]  # times 64, that is not finite: no part
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk_search.top_k(df, k=7)) == brute(rows[:-1], 7, 20)


def test_short_cells_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 8)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4))
    x = np.abs(x) / np.linalg.norm(x, axis=1)[:, None] * np.repeat([100.0, 1.0], 80)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)) == brute(rows, 3, 20)
