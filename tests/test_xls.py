"""Binary workbooks, against files that a small writer makes here."""

import struct
import tracemalloc
import zipfile

import pytest

from portolan.plans import datasets
from portolan.sources import archives, tables, xls

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def text(s, flags=0, extra=b""):
    wide = any(ord(c) > 255 for c in s)
    data = s.encode("utf-16-le" if wide else "latin-1", "surrogatepass")
    return struct.pack("<HB", len(data) // (1 + wide), wide | flags) + extra + data


def shared(strings, room):
    """The shared strings, in records of `room` bytes; characters that go on in another record say anew how wide they are."""
    out, now = [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        wide = any(ord(c) > 255 for c in s)
        size, data = 1 + wide, s.encode("utf-16-le" if wide else "latin-1")
        if len(now) + 3 > room:
            out.append(now)
            now = b""
        now += struct.pack("<HB", len(data) // size, wide)
        while data:
            fit = (room - len(now)) // size * size
            if fit <= 0:
                out.append(now)
                now = bytes([wide])
                continue
            now, data = now + data[:fit], data[fit:]
    return b"".join(record(xls.CONTINUE if i else xls.SST, d) for i, d in enumerate([*out, now]))


def cell(row, col, x, strings):
    at = struct.pack("<HHH", row, col, 15)
    if x is None:
        return b""
    if isinstance(x, bytes):  # a record of its own
        return x
    if isinstance(x, bool):
        return record(xls.BOOLERR, at + bytes([x, 0]))
    if isinstance(x, int):
        return record(xls.RK, at + struct.pack("<I", (x << 2 | 2) & 0xFFFFFFFF))
    if isinstance(x, float):
        return record(xls.NUMBER, at + struct.pack("<d", x))
    if x not in strings:
        strings[x] = len(strings)
    return record(xls.LABELSST, at + struct.pack("<I", strings[x]))


def compound(stream, sector=512, cutoff=4096):
    """A compound file with one stream; short ones lie in the root's."""
    short = len(stream) < cutoff
    size = -(-len(stream) // 64) * 64 if short else len(stream)
    n = -(-size // sector)
    data = stream.ljust(n * sector, b"\0")
    # sectors in reverse order, so that the chain matters: data, short table, directory, tables
    extra = 1 if short else 0
    tables_ = 1
    while (n + extra + 1 + tables_) * 4 > tables_ * sector:
        tables_ += 1
    links = [0xFFFFFFFE if i == 0 else i - 1 for i in range(n)] + [0xFFFFFFFE] * (extra + 1) + [0xFFFFFFFD] * tables_
    links += [0xFFFFFFFF] * (tables_ * sector // 4 - len(links))

    def entry(name, kind, first, length):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", first, length)

    body = b"".join(data[i * sector : (i + 1) * sector] for i in reversed(range(n)))
    if short:
        m = size // 64
        body += struct.pack(f"<{m}I", *[i + 1 if i < m - 1 else 0xFFFFFFFE for i in range(m)]).ljust(sector, b"\xff")
    root = entry("Root Entry", 5, n - 1 if short else 0xFFFFFFFE, size if short else 0)
    body += (root + entry("Workbook", 2, 0 if short else n - 1, len(stream))).ljust(sector, b"\0")
    body += struct.pack(f"<{len(links)}I", *links)
    places = [n + extra + 1 + i for i in range(tables_)]
    assert tables_ <= 109
    head = xls.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, sector.bit_length() - 1, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", tables_, n + extra, 0, cutoff, n if short else 0xFFFFFFFE, extra, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *places, *[0xFFFFFFFF] * (109 - tables_))
    return head.ljust(sector, b"\0") + body


def workbook(sheets, active=0, room=8224, version=0x600, before=b"", **kind):
    strings, bodies = {}, []
    bof = lambda what: record(xls.BOF, struct.pack("<HHHHII", version, what, 0, 0, 0, 0))
    for rows in sheets.values():
        cells = b"".join(cell(r, c, x, strings) for r, row in enumerate(rows) for c, x in enumerate(row))
        bodies.append(bof(0x10) + cells + record(xls.EOF))
    globals_ = bof(5) + before + record(xls.WINDOW1, struct.pack("<5H", 0, 0, 0, 0, 0) + struct.pack("<4H", active, 0, 1, 600))
    sst, end = shared(list(strings), room), record(xls.EOF)
    names = [name.encode("latin-1") for name in sheets]
    place = len(globals_) + sum(12 + len(n) for n in names) + len(sst) + len(end)
    for name, body in zip(names, bodies, strict=True):
        globals_ += record(xls.BOUNDSHEET, struct.pack("<IBBBB", place, 0, 0, len(name), 0) + name)
        place += len(body)
    return compound(globals_ + sst + end + b"".join(bodies), **kind)


ROWS = [["name", "x", "flag"], ["AÉ", 5, True], ["日本" * 30, -2.5, False], [None, 1e-7, None], ["NA", 123456789012, "w" * 40]]
WANT = [(0, "AÉ", "5", "True"), (1, "日本" * 30, "-2.5", "False"), (2, None, "1e-07", None), (3, None, "123456789012", "w" * 40)]


@pytest.mark.parametrize("kind", [{}, {"cutoff": 16}, {"cutoff": 16, "sector": 4096}, {"room": 17}, {"room": 23, "cutoff": 16}])
def test_cells(spark, tmp_path, kind):
    rows = [[float(x) if isinstance(x, int) and abs(x) > 1 << 28 else x for x in row] for row in ROWS]
    (tmp_path / "t.xls").write_bytes(workbook({"Other": [["z"]], "Data": rows}, active=1, **kind))
    got = tables.read_table(spark, str(tmp_path / "t.xls"))
    assert got.columns == ["_ord", "name", "x", "flag"] and [tuple(r) for r in got.collect()] == WANT
    assert tables.read_table(spark, str(tmp_path / "t.xls"), "Other").columns == ["_ord", "z"]


def test_other_records(spark, tmp_path):
    at = lambda r, c: struct.pack("<HHH", r, c, 15)
    number = lambda x: struct.pack("<d", x)
    special = lambda kind, value=0: bytes([kind, 0, value, 0, 0, 0, 255, 255])
    inner = record(xls.BOF, struct.pack("<HHHHII", 0x600, 0x20, 0, 0, 0, 0)) + record(xls.NUMBER, at(1, 0) + number(99.0)) + record(xls.EOF)
    packed = struct.pack("<I", struct.unpack("<Q", number(1.5))[0] >> 32)
    rows = [
        list("abcd"),
        [inner, record(xls.MULRK, struct.pack("<HH", 1, 0) + struct.pack("<HI", 15, (12345 << 2) | 3) + struct.pack("<H", 15) + packed + struct.pack("<H", 1))],
        [record(xls.FORMULA, at(2, 0) + number(0.5) + bytes(6)), record(xls.FORMULA, at(2, 1) + special(0) + bytes(6)) + record(xls.STRING, text("found")),
         record(xls.FORMULA, at(2, 2) + special(1, 1) + bytes(6)), record(xls.FORMULA, at(2, 3) + special(2, 7) + bytes(6))],
        [record(xls.FORMULA, at(3, 0) + special(3) + bytes(6)), record(xls.BOOLERR, at(3, 1) + bytes([0x24, 1])), record(xls.LABEL, at(3, 2) + text("plain")),
         record(xls.RSTRING, at(3, 3) + text("rich", 8, struct.pack("<H", 1)) + bytes(4))],
        [],
        [record(xls.RK, at(5, 0) + struct.pack("<I", (-7 << 2 | 2) & 0xFFFFFFFF))],
    ]
    (tmp_path / "t.xls").write_bytes(workbook({"S": rows}))
    assert [tuple(r)[1:] for r in tables.read_table(spark, str(tmp_path / "t.xls")).collect()] == [
        ("123.45", "1.5", None, None), ("0.5", "found", "True", "#DIV/0!"), (None, "#NUM!", "plain", "rich"), ("-7", None, None, None)]


def test_what_cannot_be_read(spark, tmp_path):
    path = tmp_path / "t.xls"
    for data, why in ((workbook({"S": ROWS}, version=0x500), "older"), (workbook({"S": ROWS}, before=record(xls.FILEPASS, b"\0\0")), "encrypted"), (workbook({}), "no sheet")):
        path.write_bytes(data)
        with pytest.raises(ValueError, match=why):
            tables.read_table(spark, str(path))
    path.write_bytes(workbook({"S": []}))
    with pytest.raises(ValueError, match="no header"):
        tables.read_table(spark, str(path))
    whole = bytearray(workbook({"S": ROWS * 50}, cutoff=16))
    (table,) = struct.unpack_from("<I", whole, 76)
    struct.pack_into("<I", whole, (table + 1) * 512 + 4, 1)  # a sector that follows itself
    path.write_bytes(bytes(whole))
    with pytest.raises(ValueError, match="broken"):
        tables.read_table(spark, str(path))


def test_both_formats_give_one_table(spark, tmp_path):
    """The TESLA table from .xls and from .xlsx, and from an .xlsx that is called .xls."""
    rows = [["peptide", "target_value", "allele", "score"]] + [["SIINFEKL"[: 8 - i % 2] + "ACDE"[i % 4], i % 2, "HLA-A*02:01", i / 8] for i in range(40)]
    (tmp_path / "t.xls").write_bytes(workbook({"S": rows}))
    shown = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f"<c><v>{xls._number(x)}</v></c>"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>" + "".join("<row>" + "".join(map(shown, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    (tmp_path / "u.xls").write_bytes((tmp_path / "t.xlsx").read_bytes())
    found = [datasets.tesla(spark, str(tmp_path / name)).collect() for name in ("t.xls", "t.xlsx", "u.xls")]
    assert len(found[0]) == 40 and sorted(map(str, found[0])) == sorted(map(str, found[1])) == sorted(map(str, found[2]))


def test_memory_stays_flat(tmp_path):
    most = []
    for n in (5_000, 40_000):
        path = tmp_path / f"{n}.xls"
        path.write_bytes(workbook({"S": [["a", "b"]] + [[f"s{i % 50}", i / 4] for i in range(n)]}, sector=4096))
        (member,) = archives.ArchiveReader([f"file://{path}"], None, ["a", "b"]).partitions()
        tracemalloc.start()
        assert sum(b.num_rows for b in archives.ArchiveReader([f"file://{path}"], None, ["a", "b"]).read(member)) == n
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 2.5 * most[0] and most[1] < 8e6
