"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from pyspark.sql import functions as F

from voxelgrove.llm.audio_fingerprint import align_recordings
from voxelgrove.llm.decontaminate import find_contamination
from voxelgrove.llm.jaccard_join import jaccard_groups
from voxelgrove.llm.language_id import identify_languages
from voxelgrove.llm.license_scan import document_paths, scan_licenses
from voxelgrove.llm.packing import pack_documents
from voxelgrove.llm.quality_fm import classify_quality
from voxelgrove.llm.sharding import shard_documents
from voxelgrove.llm.toxicity_chain import score_toxicity
from voxelgrove.llm.training_order import write_shards


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_languages(odd, empty):
    got = by_id(identify_languages(odd).collect())
    assert sum(map(len, got.values())) == 11
    for k in (3, 4, 5):
        assert [(r.lang_pred, r.score) for r in got[k]] == [("und", 0.0)]
    assert {r.lang_pred for k in (1, 2, 6, 7, 8, 9, None) for r in got[k]} <= {"en", "de"}
    assert got[1][0].lang_pred == got[1][1].lang_pred == got[2][0].lang_pred
    assert identify_languages(empty).count() == 0
    unknown = identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def test_quality(odd, empty, labels):
    got = by_id(classify_quality(odd, labels).collect())
    assert sum(map(len, got.values())) == 11
    assert all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert classify_quality(empty, labels).count() == 0
    none = classify_quality(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    same = classify_quality(odd, labels, numbers=()).where("doc_id in (3, 4)").collect()
    assert same[0].score == same[1].score


def test_toxicity(odd, empty, labels):
    rows = score_toxicity(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_group_1 <= 1 and r.toxic in (0, 1) for r in rows)
    assert score_toxicity(empty, labels).count() == 0
    assert {(r.p_toxic, r.toxic) for r in score_toxicity(odd, labels.limit(0)).collect()} == {(0.0, 0)}
    given = score_toxicity(odd, labels, categories={"animal": ("cat", "hund")}).collect()
    assert len(given) == 11 and all(0 <= r.p_animal <= 1 for r in given)


def test_jaccard(odd, empty):
    got = by_id(jaccard_groups(odd).collect())
    assert sum(map(len, got.values())) == 11
    assert [(r.n_shingles, r.component_id, r.copies) for r in got[1]] == [(9, 1, 3)] * 2
    assert got[2][0].component_id == 1
    for k in (3, 4):
        assert (got[k][0].n_shingles, got[k][0].component_id) == (0, k)
    assert got[7][0].n_shingles == 1 and got[9][0].n_shingles == 1 and got[6][0].n_shingles == 2
    assert got[None][0].component_id is None
    assert jaccard_groups(empty).count() == 0


def test_contamination(odd, empty, spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog lay on the rug"), (2, "Kurz"), (3, None), (4, ""), (None, "hund und die katze")], "item_id long, text string")
    got = by_id(find_contamination(odd, items).collect())
    assert sum(map(len, got.values())) == 11
    assert [(r.n_words, r.n_hit, r.items) for r in got[1]] == [(13, 13, ["1"])] * 2
    assert (got[7][0].n_hit, got[7][0].items) == (1, ["2"])
    assert (got[8][0].n_hit, got[8][0].items) == (4, ["null"])
    assert got[8][0].spans[0].asDict() == {"first_word": 1, "last_word": 4, "start": 4, "end": 22}
    for k in (3, 4, 5):
        assert (got[k][0].n_words, got[k][0].n_hit, got[k][0].items, got[k][0].spans) == (0, 0, [], [])
    assert got[6][0].n_words == 40_001
    assert find_contamination(empty, items).count() == 0
    assert {r.n_hit for r in find_contamination(odd, items.limit(0)).collect()} == {0}


def test_packing(odd, empty):
    rows = pack_documents(odd, length=64).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and sum(r.length for r in rows if r.doc_id == 4) == 1
    assert sum(r.doc_tokens for r in rows if r.doc_id == 1 and r.start == 0) == sum(r.length for r in rows if r.doc_id == 1)
    assert pack_documents(empty).count() == 0


def test_sharding(odd, empty):
    got = by_id(shard_documents(odd, shards=3).collect())
    assert sum(map(len, got.values())) == 11
    assert got[3][0].size == 1 and got[3][0].text_crc32 == 0 and got[4][0].size == 1
    assert len({r.shard for k in (1, 2) for r in got[k]}) == 1
    slots = {}
    for rows in got.values():
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard_documents(empty).count() == 0


def test_order(odd, empty, tmp_path):
    rows = write_shards(odd, str(tmp_path / "a"), length=32).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert [r.n_tokens for r in rows if r.doc_id == 3] == [1]
    assert len([r for r in rows if r.doc_id == 1 and r.seq == 0]) == 2
    assert write_shards(empty, str(tmp_path / "b")).count() == 0


def test_audio(odd, empty):
    recordings = odd.withColumn("media", F.col("text").cast("binary"))
    got = by_id(align_recordings(recordings, F.col("id") % 2 == 0, id_col="doc_id").withColumnRenamed("id", "doc_id").collect())
    assert sum(map(len, got.values())) == 11
    assert got[3][0].n_codes == 0 and got[3][0].matches == [] and got[3][0].class_id == 3
    assert got[1][0].class_id == got[2][0].class_id == 1
    assert align_recordings(recordings.limit(0), F.col("id") % 2 == 0, id_col="doc_id").count() == 0


def test_licenses(odd, empty, spark):
    rows = scan_licenses(document_paths(odd), keep=["doc_id"]).collect()
    assert len(rows) == 11 and all((r.own_license, r.score, r.license, r.inherited_from) == (None, 0.0, None, None) for r in rows)
    assert scan_licenses(document_paths(empty), keep=["doc_id"]).count() == 0
    tied = spark.createDataFrame([("a/LICENSE", "Licensed under the MIT License", 1), ("a/COPYING", "Licensed under the ISC License", 2), ("a/x", "", 3), ("a/x", "", 3), (None, None, 4)], "path string, text string, score int")
    got = sorted((str(r.path), r.license, r.inherited_from) for r in scan_licenses(tied).collect())
    # Of licence files that are alike in score, the least name.
    assert got[3:] == [("a/x", "ISC", "a")] * 2
    assert got[0] == ("None", None, None)
