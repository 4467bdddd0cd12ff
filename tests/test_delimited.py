"""Delimited files in splits, against the reader that takes a file as a whole."""

import random

import pytest

from portolan.sources import delimited, tables


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(rng, sep):
    cell = "".join(rng.choice(["a", "b", sep, "\n", '""', " ", "\n\n", "é", "x y"]) for _ in range(rng.randint(0, 12)))
    return f'"{cell}"'


def plain(rng):
    return rng.choice(["1", "", "word", "5'", "NA", "two words", "é"])


@pytest.mark.parametrize(("seed", "sep", "suffix"), [(1, ",", "csv"), (2, "\t", "tsv"), (3, ",", "csv")])
def test_equals_the_whole_reader(spark, tmp_path, small_splits, seed, sep, suffix):
    rng = random.Random(seed)
    rows = [sep.join(quoted(rng, sep) if rng.random() < 0.4 else plain(rng) for _ in range(3)) for _ in range(1500)]
    if seed == 3:  # cells longer than a split
        rows[700] = f'long{sep}"{chr(10).join(["line of the long cell"] * 900)}"{sep}end'
    rows = [x for x in rows if x.strip()]
    path = str(tmp_path / f"t.{suffix}")
    open(path, "w", newline="").write("\n".join([sep.join(["p", '"q\nr"', "s"]), *rows]) + "\n")
    got = tables.read_table(spark, path)
    assert got.columns == ["_ord", "p", "q\nr", "s"] and spark.read.text(path).rdd.getNumPartitions() > 4
    whole = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)
    missing = lambda x: None if x is None or x in tables.MISSING else x
    want = [tuple(map(missing, r)) for r in whole.collect()]
    found = sorted(map(tuple, got.collect()))
    assert [r[0] for r in found] == list(range(len(found)))
    assert [r[1:] for r in found] == want


def test_lines_without_breaks_stay_with_spark(spark, tmp_path, small_splits):
    path = str(tmp_path / "t.csv")
    open(path, "w").write("a,b\n\n" + "".join(f'{i},"q ""{i}"", r"\n' + "\n" * (i % 3 == 0) for i in range(800)))
    rows = tables.read_table(spark, path)
    assert "Arrow" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(i, str(i), f'q "{i}", r') for i in range(800)]


def test_states_of_a_line():
    ends = delimited.ends_open
    assert [ends(x, ",", False) for x in ('a,b', '"a', 'a"b,c', '5" tall', 'x,"', '"a""', '"a"",b', '"a",b', 'a,"b""c', '""', '"",""', '"""')] == [False, True, False, False, True, True, True, False, True, False, False, True]
    assert [ends(x, ",", True) for x in ('a,b', 'a"', 'a""', 'a",b', 'a","', '"', '')] == [True, False, True, False, True, False, True]


def test_odd_files(spark, tmp_path):
    def table(text, name="t.csv"):
        (tmp_path / name).write_bytes(text.encode())
        return sorted(map(tuple, tables.read_table(spark, str(tmp_path / name)).collect()))

    assert table('a,b\r\n1,"x\r\ny"\r\n2,z\r\n') == [(0, "1", "x\r\ny"), (1, "2", "z")]
    assert table('\ufeffa,b\n1,"x\ny"') == [(0, "1", "x\ny")]
    assert table('a,b\n1,"never closed\n2,3\n') == [(0, "1", "never closed\n2,3")]
    assert table('a,b\n5" tall,x\n7,"y\nz"\n8\n9,1,2\n') == [(0, '5" tall', "x"), (1, "7", "y\nz"), (2, "8", None), (3, "9", "1")]
    with pytest.raises(ValueError, match="header"):
        table("")
