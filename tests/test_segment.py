"""Segmentation on the hand-made token file of FIXTURES.md section 1."""

from pyspark.sql import functions as F

from kindred.operators import segment as S
from kindred.sources import files as FS

A_CS = """UsingDirective,1,0,0
BEGIN_METHOD,,,
MethodDeclaration,2,2,4
Foo.Bar,3,3,8
END_METHOD,,,
CloseBrace,4,5,0
MethodDeclaration,2,6,0
BEGIN_METHOD,,,
MethodDeclaration,2,8,4
x,5,9,8
END_METHOD,,,
CloseBrace,4,10,0
EndOfFile,6,11,0
"""


def _tokens(spark, tmp_dir, name="a.cs.tree-viewer.txt", body=A_CS, strict=True):
    p = f"{tmp_dir}/tokenized1"
    import os
    os.makedirs(p, exist_ok=True)
    with open(f"{p}/{name}", "w", newline="") as f:
        f.write(body)
    good, errors = FS.read_tokens(spark, f"{p}/*", strict=strict)
    return good, errors


def test_units_text_and_lines(spark, tmp_dir):
    t, err = _tokens(spark, tmp_dir)
    assert err.count() == 0
    t = S.drop_missing(t)
    units = S.unit_text(t).orderBy("k").collect()
    assert [(u.begin_pos, u.end_pos) for u in units] == [(1, 4), (7, 10)]
    assert units[0].text == "begin_method methoddeclaration foobar end_method"
    assert units[1].text == "begin_method methoddeclaration x end_method"
    lines = S.unit_lines(t).orderBy("k").collect()
    assert [(r.start_line, r.end_line) for r in lines] == [(2, 6), (8, 11)]
    assert all(r.reason is None for r in lines)


def test_fill_marker_lines(spark, tmp_dir):
    t, _ = _tokens(spark, tmp_dir)
    f = {r.pos: (r.line, r.kind, r.col) for r in S.fill_marker_lines(t).collect()}
    assert f[4] == (3, 8002, 0) and f[10] == (9, 8002, 0)
    assert f[1] == (2, 8001, 0) and f[7] == (8, 8001, 0)


def test_missing_tokens_keep_positions(spark, tmp_dir):
    body = A_CS.replace("CloseBrace,4,5,0", "null,4,5,0").replace("UsingDirective,1,0,0", "NA,1,0,0")
    t, _ = _tokens(spark, tmp_dir, body=body)
    kept = S.drop_missing(t)
    assert kept.count() == 11
    assert sorted(r.pos for r in kept.collect())[:2] == [1, 2]
    # END+2 row (pos 6) is still there, so unit 1 still ends at line 6
    lines = S.unit_lines(kept).orderBy("k").collect()
    assert lines[0].end_line == 6


def test_long_row_strict_and_tolerant(spark, tmp_dir):
    body = A_CS.replace("x,5,9,8", "x,5,9,8,extra")
    _, err = _tokens(spark, tmp_dir, body=body)
    assert err.count() == 1
    good, err2 = _tokens(spark, tmp_dir + "/t", body=body, strict=False)
    assert err2.count() == 1 and good.count() == 12


def test_short_row_padded(spark, tmp_dir):
    body = A_CS.replace("x,5,9,8", "x,5")
    good, err = _tokens(spark, tmp_dir, body=body)
    assert err.count() == 0
    r = good.where(F.col("token") == "x").first()
    assert r.kind == 5 and r.line is None


def test_marker_errors(spark):
    rows = [("f1", 0, "BEGIN_METHOD", 1), ("f1", 1, "x", 1),
            ("f2", 0, "BEGIN_METHOD", 1), ("f2", 1, "END_METHOD", 1), ("f2", 2, "BEGIN_METHOD", 2),
            ("f3", 0, "x", 1),
            ("f4", 0, "BEGIN_METHOD", None), ("f4", 1, "END_METHOD", None)]
    t = spark.createDataFrame(rows, "file string, pos long, token string, line int")
    e = {r.file: r.reason for r in S.parse_errors(t).collect()}
    assert e == {"f1": S.REASON_MISMATCH, "f2": S.REASON_MISMATCH, "f3": S.REASON_EMPTY,
                 "f4": S.REASON_NO_LINE}


def test_overlapping_pairs(spark):
    rows = [("f", 0, "BEGIN_METHOD", 1), ("f", 1, "BEGIN_METHOD", 2),
            ("f", 2, "END_METHOD", 3), ("f", 3, "END_METHOD", 4)]
    t = spark.createDataFrame(rows, "file string, pos long, token string, line int")
    p = sorted((r.begin_pos, r.end_pos) for r in S.pair_markers(t).collect())
    assert p == [(0, 2), (1, 3)]
    rows_in = sorted((r.k, r.pos) for r in S.unit_rows(t).collect())
    assert rows_in == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_islands(spark):
    rows = [("u", i, v) for i, v in enumerate("aaabccdddd")]
    df = spark.createDataFrame(rows, "u string, i long, v string")
    got = sorted((r.value, r.length) for r in S.islands(df, "u", "i", "v", min_length=2).collect())
    assert got == [("a", 3), ("d", 4)]


def test_slice_lines(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/src", exist_ok=True)
    with open(f"{tmp_dir}/src/a.cs", "w", newline="") as f:
        f.write("l0\r\nl1\nl2\nl3\n")
    lines = FS.read_source_lines(spark, f"{tmp_dir}/src/*")
    file = lines.first().file
    units = spark.createDataFrame([(file, 1, 1, 3), (file, 2, 2, 2)],
                                  "file string, k int, start_line long, end_line long")
    got = {r.k: r.raw for r in FS.slice_lines(lines, units, bucket=2).collect()}
    assert got == {1: "l1\nl2", 2: ""}
