"""Joins of two sides that grow with a token stream aren't broadcasts, however small the files look."""
import contextlib
import io

from kindred.operators import label as L
from kindred.operators import segment as S
from kindred.plans import runs as RU
from kindred.sources import records as R


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def _tokens(spark):
    rows = [("a", p, t, line) for p, (t, line) in enumerate([
        ("BEGIN_METHOD", None), ("x", 0), ("END_METHOD", None), ("y", 1),
        ("BEGIN_METHOD", None), ("z", 2), ("END_METHOD", None), ("w", 3), ("v", 4)])]
    return spark.createDataFrame(rows, "file string, pos long, token string, line int")


def test_rows_of_a_stream_are_not_broadcast(spark, tmp_dir):
    tokens, path = _tokens(spark), f"{tmp_dir}/t"
    tokens.write.parquet(path)
    tokens = spark.read.parquet(path)
    units = S.pair_markers(tokens)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    units.write.parquet(f"{tmp_dir}/u")
    units = spark.read.parquet(f"{tmp_dir}/u")
    lines = S.unit_lines(tokens, units=units)
    assert _plan(lines).count("SortMergeJoin") == 2  # the positions behind begin and end; the last line is one row a file
    assert [tuple(r) for r in lines.orderBy("k").collect()] == [
        ("a", 1, 0, 2, 0, 4, None), ("a", 2, 4, 6, 2, 4, None)]


def test_texts_and_findings_are_not_broadcast(spark, tmp_dir):
    lines = spark.createDataFrame([("a", k, f"l{k}") for k in range(5)], "file string, line_no long, text string")
    R.store_lines(lines, f"{tmp_dir}/lines")
    units = spark.createDataFrame([("a", 1, 0, 2), ("a", 2, 3, 9)], "file string, k int, start_line int, end_line int")
    raw = R.slice_stored(spark.read.parquet(f"{tmp_dir}/lines"), units)
    assert "BroadcastHashJoin" not in _plan(raw)
    assert {(r["k"], r["raw"]) for r in raw.collect()} == {(1, "l0\nl1"), (2, "l3\nl4")}
    report = spark.createDataFrame([("\\a", 1, "B"), ("\\a", 1, "A")], "nFile_Name string, nMethod_Line int, qName string")
    tagged = RU.label_join(units, report)
    assert "BroadcastHashJoin" not in _plan(tagged)
    assert {(r["k"], r["tags"], r["gt"]) for r in tagged.collect()} == {(1, "a,b", 1), (2, "", 0)}
    assert "BroadcastHashJoin" not in _plan(L.tag_units(units.withColumnRenamed("k", "unit_id"), report.select(
        report["nMethod_Line"].alias("unit_id"), report["qName"].alias("name"))))
