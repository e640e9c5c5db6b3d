import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from voxelgrove.llm import source_mix as M


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        share = {s: most * sizes[s] if s in stopped else left * weight[s] / sum(weight[x] for x in names if x not in stopped) for s in names}
        over = {s for s in names if s not in stopped and share[s] > most * sizes[s]}
        if not over:
            return share
        stopped |= over


def table(rng, n):
    names = ["a", "b", "ä", "Z", None, "hot"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(names)
        words = 40 if i % 7 == 0 else int(rng.lognormvariate(4, 1))
        rows.append((i, " ".join(["w"] * words), source, 1))
    return [*rows, (n, None, "a", 1), (n + 1, "", None, 1), (n + 2, " \t ", "empty", 1), (n + 3, "one", "little", 1)]


def check(rows, got):
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return want, taken


def test_targets_and_taken_words(spark):
    rows = table(random.Random(1), 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = M.mix_sources(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    want, taken = check(rows, got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t)
    assert want["little"] == taken["little"] == 3 and want["empty"] == 0


def test_small_cells_salts_and_partitions_change_nothing(spark, monkeypatch):
    rows = table(random.Random(2), 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    key = lambda df: sorted((r.doc_id, r.taken, r.target) for r in df.collect())
    want = key(M.mix_sources(docs))
    monkeypatch.setattr(M, "CELL", 3)
    assert key(M.mix_sources(docs.repartition(11))) == want
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert key(M.mix_sources(docs.repartition(3))) == want
    assert key(M.mix_sources(docs, seed=14)) != want


def test_ranks_are_those_of_pareto_sampling(spark):
    # One source and one size: the documents taken once more are the n with the lowest odds ratios.
    docs = spark.range(400).selectExpr("id as doc_id", "'a b c d' as text", "'s' as source", "id / 400 as liking")
    got = M.mix_sources(docs, prefer=F.col("liking")).collect()
    mean = sum(int(i / 400 * M.UNIT) for i in range(400)) / 400 / M.UNIT
    expected, odds = {}, {}
    for i in range(400):
        e = int((1 + 0.5 * (int(i / 400 * M.UNIT) / M.UNIT - mean)) * M.UNIT)
        p, u = e % M.UNIT / M.UNIT, (int(sha256(f"13:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        expected[i] = e // M.UNIT
        odds[i] = u / (1 - u) * (1 - p) / p if p else None
    more = {r.doc_id for r in got if r.taken // 4 > expected[r.doc_id]}
    n = round(sum(400 * [1]) - sum(expected.values()))
    assert more == set(sorted((i for i in odds if odds[i] is not None), key=lambda i: odds[i])[:n])
    # Documents that are preferred are taken more often.
    assert sum(r.taken for r in got if r.doc_id >= 200) > 1.15 * sum(r.taken for r in got if r.doc_id < 200)


def test_the_main_path_runs_no_python(spark, sf, capsys):
    M.op13_source_mix(spark, sf).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_the_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source, 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    source = {r[0]: r[2] for r in docs}
    rows = M.op13_source_mix(spark, sf).withColumn("source", F.lit("")).collect()
    want, taken = targets(sized := Counter()), Counter()
    for i, text, s, _ in docs:
        sized[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sized)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] for s in want)


def test_odd_and_empty_tables(spark, odd, empty):
    got = M.mix_sources(odd)
    rows = got.collect()
    assert got.columns == [*[c for c in odd.columns if c not in ("text", *M.ADDED)], *M.ADDED]
    check([(r.doc_id, r.text, r.source, 1) for r in odd.collect()], rows)
    assert len(rows) == 11 and M.mix_sources(empty).collect() == []
    silent = M.mix_sources(odd.where("doc_id in (3, 4)")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in silent] == [(0, 0, 0.0, 0)] * 2
    same = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "a b", "t")] * 10, "doc_id long, text string, source string")
    assert Counter((r.source, r.taken) for r in M.mix_sources(same).collect()) == Counter((r.source, r.taken) for r in M.mix_sources(same.repartition(7)).collect())
