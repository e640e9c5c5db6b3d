import re

import numpy as np
import pytest

from voxelgrove.llm.bytetext import ALNUM, hashed_words
from voxelgrove.llm.decontaminate import find_contamination, load_windows, merge_spans, write_windows
from voxelgrove.llm.fm_index import FMIndex


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for n, size in ((30, 3), (400, 4), (3000, 40)):
        text = rng.integers(1, size, n).astype(np.int32)
        text[rng.random(n) < 0.05] = 0
        text[0], text[-1] = 1, 0
        keep = np.ones(n, bool)
        keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
        text = text[keep]
        index = FMIndex(text)
        for length in (1, 2, 5):
            patterns = np.unique(rng.integers(1, 2 * size + 70, (60, length)).astype(np.int32), axis=0)
            patterns = np.unique(np.concatenate([patterns, rng.integers(1, size, (60, length)).astype(np.int32)]), axis=0)
            which, low, high = index.search(patterns)
            found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
            for k, p in enumerate(patterns):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
                assert found.get(k, []) == want


def brute(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_same_as_brute_force(spark, sf, block_bytes):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = items.union(spark.createDataFrame([(900, "The of"), (901, "é!"), (902, None)], items.schema))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_contamination(docs, items, block_bytes=block_bytes).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_spans_merge():
    s = lambda a, b: {"first_word": a, "last_word": b, "start": a * 10, "end": b * 10 + 9}
    assert merge_spans([s(5, 8), s(1, 3), s(4, 6), s(10, 12)]) == [s(1, 8), s(10, 12)]


def test_windows_of_blocks_against_loops(spark, tmp_path):
    rng = np.random.default_rng(4)
    items = [(str(i), " ".join(rng.choice(["a", "b", "c"], int(n)))) for i, n in enumerate(rng.integers(0, 30, 60))] + [("7", "a b c"), ("x", "A B C")]
    word = {}
    for blocks in (1, 9):
        paths = write_windows(spark.createDataFrame(items + items[:3], "item string, text string"), str(tmp_path / f"w{blocks}"), blocks, 10)
        got: dict[tuple, set] = {}
        for p in paths:
            w = load_windows(p)
            names = dict(enumerate(w.vocabulary.tolist(), 1))
            for n, (windows, at, of) in w.by_length.items():
                for k, x in enumerate(windows):
                    assert len(x) == n and (np.diff(of[at[k] : at[k + 1]]) > 0).all()
                    got.setdefault(tuple(names[i] for i in x.tolist()), set()).update(w.items[i] for i in of[at[k] : at[k + 1]])
        if not word:
            word = {t: int(hashed_words(np.frombuffer(t.encode(), np.uint8), np.array([0, 1]), ALNUM)[0][0]) for t in "abc"}
        want: dict[tuple, set] = {}
        for i, t in items:
            ws = [word[x] for x in t.lower().split()]
            n = min(10, len(ws))
            for k in range(len(ws) - n + 1 if ws else 0):
                want.setdefault(tuple(ws[k : k + n]), set()).add(i)
        assert got == want and (len(paths) == 1) == (blocks == 1)


def test_rows_in_no_order_and_many_blocks(spark, sf):
    """Items of one document in several blocks whose spans overlap, over rows that a shuffle hands out."""
    words = [f"w{k}" for k in range(400)]
    items = spark.createDataFrame([(k, " ".join(words[7 * k : 7 * k + 12])) for k in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 40]) + (" ." * k)) for k in range(0, 360, 3)] + [(None, None), (-1, "")], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in find_contamination(docs, items, block_bytes=500).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in got.items()} == want
    for d, r in got.items():
        assert sum(s.last_word - s.first_word + 1 for s in r.spans) == r.n_hit
        assert all(a.last_word + 1 < b.first_word for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.spans) for r in find_contamination(docs, items).collect()) == [(1, 2, 0, [], []), (2, 0, 0, [], [])]
