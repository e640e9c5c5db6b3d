from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

from voxelgrove.llm import training_order as T
from voxelgrove.llm.common import scratch
from voxelgrove.llm.tokens import Encoder, tokenizer_path


def test_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(T.permute(np.arange(n), n).tolist()) == list(range(n))
    assert (T.permute(np.arange(1000), 1000, 1) != T.permute(np.arange(1000), 1000, 2)).any()


def test_hashes_are_scaled_exactly():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 5, 1 << 20, (1 << 40) + 12345, (1 << 61) + 7):
        assert T.scaled(h, n).tolist() == [int(x) * n >> 64 for x in h.tolist()]


def brute(texts, length, end):
    """Every sequence's padded ids by (document, number)."""
    tokenizer = Encoder(tokenizer_path()).tokenizer
    out = {}
    for d, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            out[d, k // length] = (len(part), part + [end] * (length - len(part)))
    return out


def test_files_hold_every_sequence_at_its_place(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()}, 64, T.END)
    slots = []
    for k, parts in enumerate((1, 7, 50)):
        path = str(tmp_path / f"shards{k}")
        places = T.write_shards(docs.repartition(parts), path, keep=["doc_id"], length=64, shard_bytes=60_000 + 20_000 * k)
        rows = T.with_digests(places, path, 128).collect()
        assert sorted(r.slot for r in rows) == list(range(len(want)))
        files = {int(p.stem[-8:]): p.read_bytes() for p in Path(path).iterdir()}
        first = {s: min(r.slot for r in rows if r.shard == s) for s in files}
        for r in rows:
            n, ids = want[r.doc_id, r.seq]
            data = files[r.shard][r.byte : r.byte + 128]
            assert r.n_tokens == n and np.frombuffer(data, "<u2").tolist() == ids and r.tokens_crc32 == crc32(data) and r.byte == (r.slot - first[r.shard]) * 128
        assert sum(map(len, files.values())) == 128 * len(want) and len(files) > 3
        slots.append({(r.doc_id, r.seq): r.slot for r in rows})
        shard = max(files)
        assert b"".join(T.read_shard(path, shard, 128, 256)) == files[shard][256:]
    assert slots[0] == slots[1] == slots[2]
    order = [d for (d, _), _ in sorted(slots[0].items(), key=lambda x: x[1])]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1
    other = T.write_shards(docs, str(tmp_path / "other"), keep=["doc_id"], length=64, key=7).collect()
    assert {(r.doc_id, r.seq): r.slot for r in other} != slots[0]


def test_wide_ids(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    with pytest.raises(ValueError):
        T.write_shards(docs, str(tmp_path / "a"), end=70_000)
    monkeypatch.setattr(T, "id_bytes", lambda tokenizer: 4)
    rows = T.write_shards(docs, str(tmp_path / "b"), length=8, end=70_000).collect()
    data = (tmp_path / "b" / "shard-00000000.bin").read_bytes()
    assert [np.frombuffer(data[r.byte : r.byte + 32], "<u4")[r.n_tokens - 1] for r in rows] == [70_000] * 2


def test_the_query(spark, sf):
    folder = lambda: set(Path(scratch(spark).removeprefix("file://")).glob("voxelgrove/*/shards"))
    before = folder()
    rows = T.op6_training_order(spark, sf).collect()
    (path,) = folder() - before
    want = brute({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, T.SEQUENCE, T.END)
    assert {(r.doc_id, r.seq): (r.n_tokens, r.tokens_crc32) for r in rows} == {k: (n, crc32(np.array(ids, "<u2").tobytes())) for k, (n, ids) in want.items()}
    assert sum(p.stat().st_size for p in path.iterdir()) == len(rows) * T.SEQUENCE * 2
