"""Cumulative sums and nearest boxes on skewed tables, against plain versions."""

import random

from pyspark.sql import functions as F
from recollect.operators import structures as S


def test_one_far_index_makes_no_large_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 50)
    r = random.Random(1)
    rows = [(r.randrange(700), r.randrange(-3, 9)) for _ in range(1500)] + [(10**12, 5), (-(10**12), 2), (None, 4)]
    pts = spark.createDataFrame(rows, "idx long, value long")
    got = [(x["idx"], x["sum"], x["prefix_sum"]) for x in S.prefix_sums(pts).orderBy("idx").collect()]
    want, total = [], 0
    for i in sorted({i for i, _ in rows}, key=lambda i: (i is not None, i)):
        s = sum(v for j, v in rows if j == i)
        total += s
        want.append((i, s, total))
    assert got == want
    blocks, n = S._in_blocks(pts.select("idx").distinct(), S.Scratch(spark), "x", "idx")
    sizes = [x["count"] for x in blocks.groupBy("_b").count().collect()]
    assert n > 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    known = [(i, v) for i, v in rows if i is not None]
    ranges = [(0, 100), (50, 40), (-5, 10**13), (699, 699), *[(300, 310)] * 200]
    out = S.range_sums(spark.createDataFrame(known, "idx long, value long"), spark.createDataFrame(ranges, "lo long, hi long")).collect()
    assert len(out) == len(ranges) and all(x.total == sum(v for i, v in known if x.lo <= i <= x.hi) for x in out)
    up = [(i, abs(v)) for i, v in known]
    ks = [1, 2, 50, 1000, 10**9, *[77] * 100]
    found = S.find_kth(spark.createDataFrame(up, "idx long, value long"), spark.createDataFrame([(k,) for k in ks], "k long"), -1).collect()
    first = {k: next((i for i in sorted({i for i, _ in up}) if sum(v for j, v in up if j <= i) >= k), -1) for k in set(ks)}
    assert len(found) == len(ks) and all(x["idx"] == first[x.k] for x in found)


def _plain(boxes, queries, k):
    out = set()
    for q, x, y in queries:
        d = sorted((round((((b[1] + b[3]) / 2 - x) ** 2 + ((b[2] + b[4]) / 2 - y) ** 2) ** 0.5, 9), b[0]) for b in boxes)[:k]
        out |= {(q, i, dist, n + 1) for n, (dist, i) in enumerate(d)}
    return out


def test_nearest_boxes_of_a_crowd_and_of_far_points(spark):
    r = random.Random(7)
    boxes = [(i, x, y, x + 1, y + 1) for i in range(800) for x, y in [(r.random() * 3, r.random() * 3) if i % 10 else (r.random() * 1000, r.random() * 1000)]]
    boxes += [(900, 0.0, 0.0, 5000.0, 5000.0), (901, 2.0, 2.0, 2.0, 2.0), (902, 2.0, 2.0, 2.0, 2.0)]
    queries = [(0, 2.0, 2.0), (1, 500.0, 500.0), (2, -90_000.0, 40.0), (3, 999.0, 1.0), (4, 3.2, 0.1), (5, 2500.0, 2500.0)]
    b = spark.createDataFrame(boxes, "id long, min_x double, min_y double, max_x double, max_y double")
    q = spark.createDataFrame(queries, "query_id long, x double, y double")
    for k in (1, 6, 2000):
        out = S.nearest_boxes(b, q, k)
        assert {(x.query_id, x.id, round(x.distance, 9), x["rank"]) for x in out.collect()} == _plain(boxes, queries, k)
    plan = S.nearest_boxes(b, q, 6)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert S.nearest_boxes(b.limit(0), q, 3).count() == 0 and S.nearest_boxes(b, q.limit(0), 3).count() == 0
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0) for i in range(5)], b.schema)
    assert [x.id for x in S.nearest_boxes(same, spark.createDataFrame([(0, 1.0, 1.0)], q.schema), 3).orderBy("rank").collect()] == [0, 1, 2]
