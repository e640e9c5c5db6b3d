import duckdb
import numpy as np
import pytest

from voxelgrove.sources import tiff
from voxelgrove.sources.archive import BitReader, BitWriter, Field, archive_slabs, read_archive, read_archives, write_archive
from voxelgrove.sources.text import read_table, write_table
from voxelgrove.sources.volumes import embedding_volume, from_rods, rods


def test_bits():
    w = BitWriter()
    for x in (0, 1, 2, 7, 255, 10**6):
        w.unsigned(x)
    for x in (0, 1, -1, 5, -300):
        w.signed(x)
    w.write(5, 3)
    r = BitReader(w.bytes())
    assert [r.unsigned() for _ in range(6)] == [0, 1, 2, 7, 255, 10**6]
    assert [r.signed() for _ in range(5)] == [0, 1, -1, 5, -300]
    assert r.read(3) == 5 and r.read(64) >= 0


@pytest.mark.parametrize("kind", ["f4", "u2"])
def test_archive(kind):
    spans = [(2, 4), (0, 5), (1, 3)]
    values = np.arange(9 * 7).astype(kind)
    f = Field(7, 5, 8, 3, spans, values, 10.0, 250.0)
    g = Field.decode(f.encode(), kind)
    assert (g.images, g.height, g.width, g.col_begin, g.spans) == (7, 5, 8, 3, spans)
    assert (g.values == values).all() and ((g.lo, g.hi) == (10.0, 250.0) or kind == "u2")


def test_archive_files(spark, tmp_path):
    v = embedding_volume(spark, "/root/testdata/sf0.001").where("row between 3 and 9 and col < 6")
    for r in archive_slabs(v, 64, 20, 25, 2).collect():
        (tmp_path / f"{r.slab}.field").write_bytes(bytes(r.content))
    got = {(r.n, r.row, r.col): r.u for r in read_archives(spark, str(tmp_path)).collect()}
    want = {(r.n, r.row, r.col): r.u for r in v.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_tiff(spark, tmp_path):
    stack = np.arange(3 * 4 * 5).reshape(3, 4, 5)
    for kind in ("u2", "f4"):
        assert (np.stack(tiff.pages(tiff.encode(stack.astype(kind)))) == stack).all()
    (tmp_path / "a.tif").write_bytes(tiff.encode(stack.astype("u2")))
    got = {(r.n, r.row, r.col): r.u for r in tiff.read_stacks(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(n, r, c): float(stack[n, r, c]) for n, r, c in np.ndindex(3, 4, 5)}
    bad = bytearray(tiff.encode(stack.astype("u2")))
    for data in (b"GIF89a__", bytes(bad).replace(b"\x02\x01\x03\x00\x01\x00\x00\x00\x10\x00", b"\x02\x01\x03\x00\x01\x00\x00\x00\x08\x00")):
        with pytest.raises(ValueError):
            tiff.pages(data)


def plain_decoder(data, kind):
    """The format bit by bit, with the tables of all the picture's columns, indexed by the column itself."""
    bits = "".join(f"{b:08b}" for b in data)
    at = 0

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    def ue():
        zeros = 0
        while take(1) == 0:
            zeros += 1
        return (1 << zeros) + take(zeros) - 1

    def se():
        k = ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)

    images, rows, cols, stride, begin, end = (ue() for _ in range(6))
    tables = []
    for _ in range(2):
        count = ue()
        table = [ue()]
        for _ in range(count - 1):
            table.append((table[-1] + se()) % (1 << 32))
        tables.append(table)
    start, base = tables
    assert len(start) == cols and len(base) == cols + 1
    ends = [np.uint32(take(32)).view(np.float32) for _ in range(2)] if kind == "f4" else None
    out = {}
    for col in range(begin, end):
        for row in range(start[col], start[col] + (base[col + 1] - base[col]) // stride):
            for n in range(images):
                x = take(32 if kind == "f4" else 16)
                out[n, row, col] = float(np.uint32(x).view(np.float32)) if kind == "f4" else x
    assert len(bits) - at < 8 and set(bits[at:]) <= {"0"} and all(start[c] == (1 << 32) - 1 for c in range(cols) if not begin <= c < end)
    return (images, rows, cols, stride, begin, end), ends, out


@pytest.mark.parametrize(("images", "kind"), [(3, "f4"), (35, "f4"), (2, "u2"), (70, "u2")])
def test_one_archive_by_many_tasks(spark, tmp_path, images, kind):
    rng = np.random.default_rng(images)
    rows = [(n, r, c, float(rng.integers(0, 60000)) if kind == "u2" else float(np.float32(rng.random()))) for c in range(3, 9) for r in range(20) if (r - 9.5) ** 2 + (c - 5.6) ** 2 < 12 for n in range(images)]
    v = spark.createDataFrame(rows, "n int, row int, col int, u double").repartition(5)
    path = str(tmp_path / "whole.field")
    write_archive(v, path, images, 20, 11, lo=10.0, hi=250.0, kind=kind)
    head, ends, found = plain_decoder((tmp_path / "whole.field").read_bytes(), kind)
    cols = sorted({c for _, _, c, _ in rows})
    assert head == (images, 20, 11, -(-images * (4 if kind == "f4" else 2) // 128) * 128 // (4 if kind == "f4" else 2), cols[0], cols[-1] + 1)
    assert found == {(n, r, c): u for n, r, c, u in rows} and (kind == "u2" or ends == [10.0, 250.0])
    assert Field.decode((tmp_path / "whole.field").read_bytes(), kind).values.tolist() == [found[k] for k in sorted(found, key=lambda k: (k[2], k[1], k[0]))]
    back, field = read_archive(spark, path, kind)
    assert {(r.n, r.row, r.col): r.u for r in back.collect()} == found and field.width == 11
    with pytest.raises(ValueError, match="gaps"):
        write_archive(v.where("not (row = 9 and col = 5 and n = 1)"), path, images, 20, 11)


def lzw(data):
    """A plain LZW encoder of the format: high bits first, codes one wider as soon as the next but one needs it."""
    out, width, known, last = [], 9, {bytes([k]): k for k in range(256)}, b""
    bits = f"{256:09b}"
    for byte in data:
        text = last + bytes([byte])
        if text in known:
            last = text
            continue
        bits += f"{known[last]:0{width}b}"
        known[text] = len(known) + 2
        if len(known) + 2 == 4094:
            bits += f"{256:0{width}b}"
            known, width = {bytes([k]): k for k in range(256)}, 9
        else:
            width = max(9, (len(known) + 2).bit_length())
        last = bytes([byte])
    bits += f"{known[last]:0{width}b}" if last else ""
    bits += f"{257:0{max(9, (len(known) + 3).bit_length())}b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def pack_bits(data):
    out, at = b"", 0
    while at < len(data):
        run = next((k for k in range(1, 128) if data[at + k : at + k + 1] != data[at : at + 1]), 128)
        if run > 2:
            out, at = out + bytes([257 - run, data[at]]), at + run
        else:
            part = data[at : at + 5]
            out, at = out + bytes([len(part) - 1]) + part, at + len(part)
    return out


def tiff_file(page, order, big, rows, way, predictor):
    """One page in strips, written by hand in either byte order."""
    import struct
    import zlib

    h, w = page.shape
    kind, item = (page.dtype.kind, page.dtype.itemsize)
    strips = []
    for r in range(0, h, rows):
        part = page[r : r + rows].astype(order + page.dtype.str[1:])
        if predictor == 2:
            whole = part.view(order + f"u{item}").astype(f"u{item}")
            part = np.diff(whole, axis=1, prepend=np.zeros((len(part), 1), whole.dtype)).astype(order + f"u{item}")
        raw = part.tobytes()
        if predictor == 3:
            planes = np.ascontiguousarray(page[r : r + rows].astype(">f4")).view(np.uint8).reshape(-1, w, 4).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
        strips.append({1: lambda x: x, 5: lzw, 8: zlib.compress, 32773: pack_bits}[way](raw))
    o, entry = ("Q", "HHQ") if big else ("I", "HHI")
    room = 8 if big else 4
    body = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHH", 43, 8, 0) if big else struct.pack(order + "H", 42)) + struct.pack(order + o, 0))
    at = []
    for x in strips:
        at.append(len(body))
        body += x
    tags = [(256, "I", 4, [w]), (257, "I", 4, [h]), (258, "H", 3, [8 * item]), (259, "H", 3, [way]), (273, o, 16 if big else 4, at), (277, "H", 3, [1]), (278, "I", 4, [rows]), (279, "I", 4, [len(x) for x in strips]), (317, "H", 3, [predictor]), (339, "H", 3, [3 if kind == "f" else 1])]
    rows_of = []
    for tag, code, number, values in tags:
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(raw) > room:
            raw, start = struct.pack(order + o, len(body)), raw
            body += start
        rows_of.append(struct.pack(order + entry, tag, number, len(values)) + raw.ljust(room, b"\0"))
    where = len(body)
    body += struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(rows_of) + struct.pack(order + o, 0)
    body[8 if big else 4 : 16 if big else 8] = struct.pack(order + o, where)
    return bytes(body)


@pytest.mark.parametrize("way", [1, 5, 8, 32773])
@pytest.mark.parametrize(("kind", "predictor"), [("u2", 1), ("u2", 2), ("f4", 1), ("f4", 2), ("f4", 3)])
def test_tiff_compressions(way, kind, predictor):
    rng = np.random.default_rng(way + predictor)
    page = (rng.integers(0, 7, (61, 83)) * rng.integers(0, 9000, (61, 83))).astype(kind) if kind == "u2" else (rng.standard_normal((61, 83)).round(1) * 1000).astype(kind)
    for order, big, rows in (("<", False, 61), (">", True, 7), (">", False, 10)):
        (got,) = tiff.pages(tiff_file(page, order, big, rows, way, predictor))
        assert (got == page).all()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 1 << 16, (9, 50, 70)).astype("u2")
    for k, (a, b, more) in enumerate(((0, 5, {"big": True, "tile": (16, 32), "deflate": True}), (5, 6, {}), (6, 9, {"tile": (16, 16)}))):
        (tmp_path / f"scan-{k}.tif").write_bytes(tiff.encode(stack[a:b], **more))
    scan = tiff.Scan.open(spark, str(tmp_path / "*.tif"))
    assert (scan.images, scan.shape, scan.kind) == (9, (50, 70), "u2")
    v = scan.voxels(part_bytes=4096)
    assert v.rdd.getNumPartitions() > 12
    got = np.full(stack.shape, -1.0)
    rows = v.toPandas()
    assert len(rows) == stack.size
    got[rows.n, rows.row, rows.col] = rows.u
    assert (got == stack).all()
    middle = scan.voxels(4, 3).toPandas()
    assert len(middle) == 3 * 50 * 70 and (middle.sort_values(["n", "row", "col"]).u.to_numpy().reshape(3, 50, 70) == stack[4:7]).all()
    (tmp_path / "z.tif").write_bytes(tiff.encode(stack[:1, :49]))
    with pytest.raises(ValueError, match="differ"):
        tiff.Scan.open(spark, [str(tmp_path / "scan-0.tif"), str(tmp_path / "z.tif")])


def test_broken_tiff_files():
    page = np.arange(4000).reshape(50, 80).astype("u2")
    whole = tiff_file(page, "<", False, 50, 1, 1)
    for bad in (b"", b"II", b"GIF89a__", whole[:-60], b"II*\0\x08\0\0\0" + b"\0\0" + b"\x08\0\0\0"):
        with pytest.raises(ValueError):
            tiff.pages(bad)
    with pytest.raises(ValueError, match="LZW"):
        tiff._lzw(bytes([0xFF, 0x00, 0x10]))


def test_written_scan(spark, tmp_path):
    v = embedding_volume(spark, "/root/testdata/sf0.001").selectExpr("n", "row", "col", "cast((u + 1) * 20000 as int) as u")
    tiff.write_scan(v, str(tmp_path / "scan"), pages_each=7)
    back = tiff.Scan.open(spark, str(tmp_path / "scan")).voxels()
    assert back.join(v, ["n", "row", "col"]).where(back.u == v.u).count() == v.count()


def test_scans_keep_every_number_and_page(spark, tmp_path):
    rows = [(1, 0, 0, 65536.0), (1, 1, 2, 107082.0), (4, 0, 1, -3.0), (4, 1, 1, None), (6, 0, 0, 0.25)]
    v = spark.createDataFrame(rows, "n int, row int, col int, u double")
    tiff.write_scan(v, str(tmp_path / "scan"), pages_each=2, kind="f4")
    scan = tiff.Scan.open(spark, str(tmp_path / "scan"))
    back = {(r.n, r.row, r.col): r.u for r in scan.voxels().collect()}
    assert scan.images == 7 and len(back) == 7 * 2 * 3
    assert all(np.isnan(back[n, r, c]) if u is None else back[n, r, c] == u for n, r, c, u in rows)
    for k, (u, kind) in enumerate([(65536.0, "u2"), (-1.0, "u2"), (None, "u2"), (2.0**24 + 1, "f4")]):
        with pytest.raises(Exception, match="write floats" if kind == "u2" else "too large"):
            tiff.write_scan(spark.createDataFrame([(0, 0, 0, u)], v.schema), str(tmp_path / f"bad-{k}"), kind=kind)


def test_tiff_scan_query_beyond_16_bits(spark, tmp_path):
    from voxelgrove.jobs.volume_queries import ORACLES, QUERIES

    values = [0.0, 655.35, 655.36, 1070.82, -4.5, None, *[k / 4 for k in range(58)]]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(f"SELECT n, \"row\", \"col\", u FROM ({ORACLES['tiff_scan']})").fetchall()
    got = [tuple(r) for r in QUERIES["tiff_scan"](spark, str(tmp_path)).select("n", "row", "col", "u").collect()]
    assert len(got) == len(values) and sorted(got, key=str) == sorted(want, key=str)


def test_text_table(spark, tmp_path):
    write_table(spark.createDataFrame([(0.5, 1.25), (0.75, 2.0)], "brightness double, ch0 double").coalesce(1), str(tmp_path / "t"))
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "t")).collect())) == [(0.5, 1.25), (0.75, 2.0)]


def test_rods(spark):
    v = embedding_volume(spark, "/root/testdata/sf0.001").where("col = 3")
    assert sorted(map(tuple, from_rods(rods(v)).select("n", "row", "col", "u").collect())) == sorted(map(tuple, v.collect()))
