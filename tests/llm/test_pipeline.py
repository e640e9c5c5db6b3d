import numpy as np

import corpus_pipeline
from voxelgrove.llm.tokens import Encoder, tokenizer_path

from .test_decontaminate import brute as windows
from .test_jaccard_join import brute as groups


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
        assert kept[-1].columns == docs.columns
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert all(rows[k + 1][i] == rows[k][i] for k in range(4) for i in rows[k + 1])
    assert len(ids[1]) >= 0.97 * len(ids[0]) and len(ids[2]) >= 0.75 * len(ids[1])
    component = groups([(i, r.text) for i, r in rows[2].items()])
    assert sorted(ids[3]) == sorted(i for i, (_, c) in component.items() if c == i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = windows([(i, r.text) for i, r in rows[3].items()], items)
    assert sorted(ids[4]) == sorted(i for i, (_, n, _) in hit.items() if not n)
    pieces = corpus_pipeline.packing(spark, kept[4], sf).collect()
    tokenizer = Encoder(tokenizer_path()).tokenizer
    total = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows[4].items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == total


def test_whole_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and np.all([0 < r.length <= 2048 for r in rows])


def rows_of(df):
    return sorted(map(str, df.select(*corpus_pipeline.COLUMNS).collect()))


def test_odd_and_empty_tables(spark, sf, odd, empty):
    every, plain = rows_of(odd), rows_of(odd.where("doc_id is null or doc_id not in (3, 4, 5)"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, sf)
        assert none.collect() == [] and none.columns == (corpus_pipeline.COLUMNS if name != "packing" else ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    # Without a letter there is no language; what stays is unchanged, and columns beyond those of documents go.
    known = rows_of(corpus_pipeline.language_id(spark, odd, sf))
    assert set(known) <= set(plain) and len(known) >= len(plain) - 2
    assert set(rows_of(corpus_pipeline.quality(spark, odd, sf))) <= set(every)
    assert rows_of(corpus_pipeline.decontaminate(spark, odd, sf)) == every
    kept = rows_of(corpus_pipeline.deduplicate(spark, odd, sf))
    assert len(kept) == len(every) - 2 and set(kept) <= set(every) and sum("doc_id=None" in r for r in kept) == 1
    tokenizer, want, got = Encoder(tokenizer_path()).tokenizer, {}, {}
    for r in odd.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    for p in corpus_pipeline.packing(spark, odd, sf).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} <= {1, 6, 7, 8, 9, None}


def test_rows_that_repeat_are_one_document(spark, sf, odd):
    left = corpus_pipeline.deduplicate(spark, odd, sf).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9]
