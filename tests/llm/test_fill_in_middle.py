import random
import re
from hashlib import sha256

import numpy as np

from voxelgrove.llm import fill_in_middle as M

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = [int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def hexed(text):
    return sha256(text.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    parts = ["wort", "ä", "漢字漢", "😀", " ", "  ", "\n", "\t\r\x0b\x0c", "\x1c", " ", "x" * 90, "<P", ">", "<", "S", "M>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*made, None, "", " ", "   \n", "a", "a ", " a", "<M> in it", "é" * 500, " " * 300, "w " * 5000 + "end", "長" * 40_000]


def test_every_text_at_several_frame_sizes(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: brute(k, t) for k, t in rows}
    for frame in (7, 64, M.FRAME):
        got = M.fill_in_middle(M.store_frames(docs, keep=["doc_id"], frame=frame), frame=frame + 1).collect()
        assert len(got) == len(rows) and {w[1] for w in want.values()} == {"plain", "spm", "psm"}
        for r in got:
            n, form, p, m, output = want[r.doc_id]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
            assert M.output_text(r.output_frames) == output
            assert r.output_sha256 == hexed(output) and r.restored_sha256 == hexed(rows[r.doc_id][1] or "")


def test_a_cut_reads_one_frame():
    data = ("word " * 20_000).encode()
    ends = np.arange(4, len(data), 5)
    edges = [0, *M.frame_edges(len(data), np.append(ends, len(data)), 4096)]
    frames = [M.packed(data[a:b]) for a, b in zip(edges, edges[1:])]
    units = np.searchsorted(np.append(ends, len(data)), edges, side="right")
    source = M.Frames(frames, np.diff(edges), units, np.array(edges))
    read, plain = [], source.read
    source.read = lambda k: read.append(k) or plain(k)
    assert source.cut(12_345) == (12_345 * 5 - 1, 12_345 * 5 - 1) and len(read) == 1
    assert source.cut(0) == (0, 0) and source.cut(20_001) == (len(data), len(data)) and len(read) == 2
    assert len(b"".join(source.stream(5000, 9000))) == 4000 and len(read) < 6


def test_the_query(spark, sf):
    want = {r.doc_id: brute(r.doc_id, r.text) + (hexed(r.text or ""),) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = M.op11_fill_in_middle(spark, sf).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got} == {k: (*w[:4], hexed(w[4]), w[5]) for k, w in want.items()}


def test_odd_and_empty_tables(spark, odd, empty):
    clash = odd.selectExpr("*", "'taken' as n", "'taken' as form", "'taken' as frames")
    got = M.fill_in_middle(M.store_frames(clash), outputs=False)
    rows = got.collect()
    assert got.columns.count("form") == got.columns.count("n") == 1 and "frames" not in got.columns and "license" in got.columns
    want = sorted(str((i, brute(i, t)[:4])) for i, t in ((r.doc_id, r.text) for r in odd.collect()))
    assert sorted(str((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars))) for r in rows) == want
    assert M.fill_in_middle(M.store_frames(empty)).collect() == []
