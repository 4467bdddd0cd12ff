"""The archive data source."""

import tracemalloc
import zipfile

import pytest

from portolan.sources import archives, tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_members_are_partitions(spark, tmp_path):
    for k in (1, 2):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in ("x", "y"):
                z.writestr(f"d/{m}.tsv", "p\tq\n" + "".join(f"{k}{m}{i}\tNA\n\n" for i in range(5)))
            z.writestr("note.md", "no table")
    with pytest.raises(ValueError, match="3 files"):
        tables.read_table(spark, str(tmp_path / "a1.zip"))
    with pytest.raises(ValueError, match="no member"):
        tables.read_table(spark, str(tmp_path / "a1.zip"), "z.tsv")
    one = tables.read_table(spark, str(tmp_path / "a2.zip"), "d/y.tsv")
    assert [tuple(r) for r in one.collect()] == [(i, f"2y{i}", None) for i in range(5)]
    all_ = archives.read(spark, str(tmp_path / "a*.zip"), "d/*.tsv")
    assert all_.rdd.getNumPartitions() == 4
    assert [r.p for r in all_.orderBy("_ord").collect()] == [f"{k}{m}{i}" for k in (1, 2) for m in "xy" for i in range(5)]
    assert archives.read(spark, str(tmp_path), "d/*.tsv").count() == 20
    with pytest.raises(ValueError, match="no such file"):
        tables.read_table(spark, str(tmp_path / "b.zip"))


def peak(reader):
    """Bytes that Python holds at most while a member is read, and its rows."""
    (member,) = reader.partitions()
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in reader.read(member))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_memory_stays_flat_for_text(tmp_path):
    found = []
    for n in (30_000, 150_000):
        path = tmp_path / f"{n}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("t.csv", "w", force_zip64=True) as out:
            out.write(b"a,b\n")
            for i in range(n):
                out.write(f'{i},"{"cell " * 40}\n"\n'.encode())
        found.append(peak(archives.ArchiveReader([f"file://{path}"], None, ["a", "b"])))
    assert [f[1] for f in found] == [30_000, 150_000]
    # 31 MB of text pass in the larger member
    assert found[1][0] < 1.2 * found[0][0] and found[1][0] < 24e6


def test_memory_stays_flat_for_sheets(tmp_path):
    found = []
    for n in (5_000, 40_000):
        path = tmp_path / f"{n}.xlsx"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>s{i}</t></si>" for i in range(50)) + "</sst>")
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                out.write(f'<worksheet {NS}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'.encode())
                for i in range(n):
                    out.write(f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{i % 50}</v></c><c r="B{i + 2}"><v>{i}</v></c></row>'.encode())
                out.write(b"</sheetData></worksheet>")
        found.append(peak(archives.ArchiveReader([f"file://{path}"], None, ["s0", "s1"])))
    assert [f[1] for f in found] == [5_000, 40_000] and found[1][0] < 2.5 * found[0][0] and found[1][0] < 8e6


def test_sheet_cells(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>name</t></si><si><r><t>A</t></r><r><t>É</t></r><rPh><t>phonetic</t></rPh></si><si/></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>flag</t></is></c></row><row/>'
                   '<row><c r="A3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c></row><row><c r="C4"><v>2.5</v></c></row><row><c r="A5" t="s"><v>2</v></c></row></sheetData></worksheet>')
    rows = tables.read_table(spark, str(tmp_path / "w.xlsx"))
    assert [tuple(r) for r in rows.collect()] == [(0, "AÉ", None, "True"), (1, None, None, "2.5")]


def test_other_header(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n")
        z.writestr("y.csv", "a,c\n1,2\n")
        z.writestr("z.csv", "")
    with pytest.raises(Exception, match="other columns"):
        archives.read(spark, str(tmp_path / "a.zip"), "[xy].csv").collect()
    with pytest.raises(ValueError, match="no header"):
        archives.read(spark, str(tmp_path / "a.zip"), "z.csv")
