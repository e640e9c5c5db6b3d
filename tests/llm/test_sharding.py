import random

import numpy as np

from voxelgrove.llm import sharding as S
from voxelgrove.llm.sharding import shard_documents


def test_nearly_equal_and_groups_whole(spark, sf):
    rows = shard_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    size, of = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert set(size) == set(range(8)) and max(size.values()) < 1.01 * min(size.values())
    assert all(len(s) == 1 for s in of.values())


def test_a_text_of_a_third_of_all_rows_is_subdivided(spark):
    rng = random.Random(1)
    texts = ["hot text of some length"] * 1500 + ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    rows = shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=5).collect()
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert len(rows) == 4500 and max(size.values()) < 1.02 * min(size.values())
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_digests_and_order_against_brute_force(spark, sf):
    from zlib import crc32

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    one, two = (shard_documents(docs.repartition(n)).collect() for n in (1, 9))
    for rows in (one, two):
        assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 1, crc32(t.encode())) for k, t in texts.items()}
        for s in range(8):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))
    assert {(r.doc_id, r.shard, r.slot) for r in one} == {(r.doc_id, r.shard, r.slot) for r in two}


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    # One draw a range: most first ranges are far off their size.
    from voxelgrove.llm import sharding

    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    rng = random.Random(2)
    texts = ["x" * rng.choice([1, 1, 1, 400]) + str(rng.random()) for _ in range(3000)] + ["the same text and id"] * 300
    rows = [(k if k < 3000 else 1, t) for k, t in enumerate(texts)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert len(got) == 3300 and max(size.values()) < 1.02 * min(size.values())


def test_splitters_against_a_walk_over_the_draws():
    rng = np.random.default_rng(3)
    for n, ranges in ((1, 4), (50, 7), (400, 30), (400, 500)):
        draws = sorted({(int(h), int(s)): int(w) for h, s, w in zip(rng.choice([*rng.integers(-(1 << 62), 1 << 62, n), 5, 5, 5], n), rng.integers(-9, 9, n), rng.integers(1, 4, n), strict=True)}.items())
        sample = S.Sample(*(np.array(x, np.int64) for x in zip(*[(h, s, w) for (h, s), w in draws], strict=True)))
        total, want, seen, due = sum(w for _, w in draws), [], 0, 1
        for key, w in draws:
            seen += w
            while due < ranges and seen >= due * (total / ranges):
                want.append(key)
                due += 1
        twice = {a[0] for a, b in zip(want, want[1:], strict=False) if a[0] == b[0]}
        fenced = {(h, s if h in twice else S.LOW) for h, s in want} | {(h, S.LOW) for h in twice} | {(h + 1, S.LOW) for h in twice}
        assert S._splitters(sample, ranges) == fenced
        a, b = sorted((draws[n // 3 % len(draws)][0], draws[-1][0]))
        assert list(zip(*(x.tolist() for x in sample.between(a, b)), strict=True)) == [(*k, w) for k, w in draws if a <= k < b]
    assert S._splitters(S.Sample(*[np.zeros(0, np.int64)] * 3), 9) == set()


def test_draws_are_the_sizes_rounded_at_random(spark):
    keys = spark.range(4000).selectExpr("id % 300 AS _h", "id AS _s", "id % 97 + 1 AS size")
    total = sum(k % 97 + 1 for k in range(4000))
    got = S._sample(keys, total, 1000, 7)
    share = {(k % 300, k): (k % 97 + 1) * 1000 / total for k in range(4000)}
    found = dict(zip(zip(got.h.tolist(), got.s.tolist(), strict=True), got.weight.tolist(), strict=True))
    assert list(found) == sorted(found) and all(abs(found.get(k, 0) - x) < 1 for k, x in share.items()) and abs(sum(found.values()) - 1000) < 100
    again = S._sample(keys.repartition(11), total, 1000, 7)
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
