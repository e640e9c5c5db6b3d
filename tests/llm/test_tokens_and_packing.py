import numpy as np
import pytest

from voxelgrove.llm import tokens
from voxelgrove.llm.packing import Packer, pack_documents
from voxelgrove.llm.tokens import Encoder, tokenizer_path


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])])


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@pytest.mark.parametrize("most", [tokens.MOST_CHUNKS, 5])
def test_ids_are_the_tokenizers_own(encoder, monkeypatch, sf, spark, most):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", most)
    rng = np.random.default_rng(0)
    parts = [*"ab1 \n\t'", " ", "　", "é", "?!", "漢", "😀", "\u0085", "\x1c", "<|endoftext|>", "'s", "'ll", "  ", "\r\n", " ", "x" * 300]
    texts = ["".join(rng.choice(parts, size=rng.integers(0, 40))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids, begins = encoder.encode(*flat(part))
        want = [e.ids for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == want


def check_sequences(pieces, length):
    """pieces: (doc, start, size, sequence, offset)."""
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in pieces:
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    for parts in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
    sizes = [sum(n for _, n in parts) for parts in by_seq.values()]
    assert max(sizes) <= length
    return sum(0 if (n & (n - 1)) == 0 else length - n for n in sizes)


@pytest.mark.parametrize("most_open", [4096, 3])
def test_packer_uses_each_token_once_without_padding(most_open):
    rng = np.random.default_rng(2)
    p = Packer(64, 0, most_open)
    sizes = np.concatenate([rng.integers(1, 64, 400), rng.integers(1, 400, 50), [64, 128, 1, 1]])
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype=np.uint32))
    p.join(last=True)
    pieces = [(d, s, len(ids), q, o) for (d, s, ids, _), q, o in p.done]
    assert all((ids == np.arange(s, s + len(ids))).all() for (_, s, ids, _), _, _ in p.done)
    assert sum(x[2] for x in pieces) == sizes.sum()
    assert check_sequences(pieces, 64) == 0


def test_level_makes_the_sum_of_squares_least():
    rng = np.random.default_rng(3)
    p = Packer(16, 0)
    for _ in range(300):
        p.levels[:] = 0
        p.levels[1:16] = rng.integers(0, 5, 15)
        s = int(rng.integers(1, 16))
        options = {}
        for h in [0, *[h for h in range(1, 17 - s) if p.levels[h]]]:
            n = p.levels.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            options[h] = int((n[1:16] ** 2).sum())
        least = min(options.values())
        assert p.level_for(s) == max(h for h, v in options.items() if v == least)


def test_pieces_of_documents(spark, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack_documents(docs, keep=["doc_id"], length=256).collect()
    assert check_sequences([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], 256) == 0
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole[r.doc_id] = whole.get(r.doc_id, []) + np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(r.ids) == 4 * r.length
    assert whole == {k: [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
