"""Files read by ranges equal files read by one task."""

import random

import pytest

from kickmill.sources.readers import read_csv, read_ranges


def rows_of(df):
    return sorted(tuple(r) for r in df.select("row_index", *[c for c in df.columns if c != "row_index"]).collect())


def written(r, n, delimiter, end):
    cell = lambda: r.choice(["", "x", "a b", "12.5", '"quoted"', f'"with {delimiter} in it"', '"two\nlines"', '"say ""hi"""', '""', '"\n\n"', '"a\n""b""\nc"', "café", "5' tall"])
    out = [delimiter.join([" Div ", '"Home Team"', "Away", "Note"])]
    for i in range(n):
        out.append(delimiter.join([str(i), cell(), cell(), cell()][: r.choice([4, 4, 4, 3])]))
        if r.random() < 0.05:
            out.append("")
    return (end.join(out) + r.choice(["", end])).replace("\n", "\n")


@pytest.mark.parametrize("seed, delimiter, end, encoding", [(1, ",", "\n", "utf-8"), (2, ";", "\n", "latin-1"), (3, ",", "\r\n", "utf-8-sig"), (4, "\t", "\n", "utf-8")])
def test_ranges_equal_one_task(spark, tmp_path, seed, delimiter, end, encoding):
    path = tmp_path / "f.csv"
    path.write_bytes(written(random.Random(seed), 60, delimiter, end).encode(encoding))
    want = rows_of(read_csv(spark, f"file://{path}"))
    assert [w[0] for w in want] == list(range(60))
    for size in ("37", "211", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = read_ranges(spark, f"file://{path}")
            assert rows_of(got) == want
            assert got.columns == ["Div", "Home Team", "Away", "Note", "row_index"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_folder_is_read_in_order_of_names(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("a,b\n" + "".join(f"{k}{i},\"x\n{i}\"\n" for i in range(4)))
    got = rows_of(read_csv(spark, f"file://{tmp_path}"))
    assert got == [(4 * k + i, f"{k}{i}", f"x\n{i}") for k in range(3) for i in range(4)]
