"""Source files of documents are written in parts by many tasks; the rows stay."""

from kindred.plans import streams as ST


def test_parts_of_a_folder_give_the_same_slices(spark, tmp_path, monkeypatch):
    rows = [(i, "\n".join(f"{i} line {k}" for k in range(i % 13))) for i in range(400)] + [(401, None), (405, "a\r\nb\nc\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def table():
        return sorted((r.file, r.doc_id, r.raw) for r in ST.unit_slices(spark, str(tmp_path)).collect())
    whole = table()
    read, paths = ST.FS.read_source_lines, []
    monkeypatch.setattr(ST.FS, "read_source_lines", lambda s, p: paths.append(s.read.text(p).inputFiles()) or read(s, p))
    monkeypatch.setattr(ST, "SOURCE_BYTES", 2000)
    assert table() == whole and len(whole) == 402
    assert len(paths[0]) > 8  # four files before
    assert dict((d, r) for _, d, r in whole)[12] == "\n".join(f"12 line {k}" for k in range(3, 9))
