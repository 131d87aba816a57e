"""The spreadsheet data source: round trips, planned partitions, pushed filters, failed tasks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from finlattice.sources import spreadsheets, workbook


def written(spark, folder, names=("a", "b", "c"), rows=50):
    c = spark.range(rows).select(F.explode(F.array(*map(F.lit, names))).alias("n"), F.explode(F.array(F.lit("One"), F.lit("Two & <three>"))).alias("sheet"), (F.col("id") + 1).cast("int").alias("row_no"))
    c = c.select(F.concat("n", F.lit(".xlsx")).alias("name"), "sheet", "row_no", F.inline(F.array(*(F.struct(F.lit(k).alias("col_no"), F.concat_ws("-", "n", "sheet", "row_no", F.lit(k)).alias("value"), F.lit("plain").alias("style")) for k in (1, 2, 28)))))
    spreadsheets.save(workbook.files(c), str(folder))
    return {(f"{folder}/{r['name']}", r.sheet, r.row_no, r.col_no, r.value) for r in c.collect()}


def test_round_trip_and_filters(spark, tmp_path):
    want = written(spark, tmp_path / "out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.xlsx", "b.xlsx", "c.xlsx"]
    back = spreadsheets.cells(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == want and back.rdd.getNumPartitions() == 6
    one = back.where("sheet = 'One' and row_no > 10 and row_no <= 12 and col_no in (2, 28)")
    assert {tuple(r) for r in one.collect()} == {w for w in want if w[1] == "One" and w[2] in (11, 12) and w[3] > 1}
    assert one.rdd.getNumPartitions() == 3
    assert {tuple(r) for r in spreadsheets.cells(spark, f"{tmp_path}/out/b.xlsx").collect()} == {w for w in want if w[0].endswith("b.xlsx")}
    assert spreadsheets.cells(spark, str(tmp_path / "none")).count() == 0


def test_a_large_sheet_is_read_by_several_tasks(spark, tmp_path):
    want = written(spark, tmp_path / "out", ["a"], 400)
    back = spreadsheets.cells(spark, str(tmp_path / "out"), split_bytes=20_000)
    assert back.rdd.getNumPartitions() > 4 and sorted(tuple(r) for r in back.collect()) == sorted(want)
    few = back.where("row_no = 399")
    assert few.count() == 6 and few.rdd.getNumPartitions() == 2


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = [(f"{i}.xlsx", b"x" if i != 7 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="content"):
        spreadsheets.save(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    spreadsheets.save(df.where("content is not null"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 11


def test_shared_strings_and_numbers(tmp_path, spark):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="x" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{m}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3"><v>4.5</v></c><c r="D3"/></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    assert [tuple(c)[1:] for c in spreadsheets.cells(spark, str(tmp_path)).collect()] == [("S", 3, 2, "one"), ("S", 3, 3, "4.5")]


def test_the_driver_knows_folders_and_not_files(spark, tmp_path, monkeypatch):
    from finlattice import catalogue_jobs

    monkeypatch.setattr(catalogue_jobs, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    assert catalogue_jobs.QUERIES["spreadsheet_source"](spark, "/root/testdata/sf0.001").count()
    made, root = sorted(tmp_path.rglob("*.xlsx")), tmp_path / "spreadsheets"
    planned = spreadsheets.CellReader({"path": str(root)}).partitions()
    assert len(made) > 100 and not any(p.name in str(planned) for p in made) and len(planned) <= 8
    assert [p.name for p in root.iterdir()] == ["dealt"]


def test_dealt_files(spark, tmp_path):
    c = spark.range(95).select(F.concat("id", F.lit(".xlsx")).alias("name"), F.lit("S").alias("sheet"), F.lit(1).alias("row_no"), F.lit(1).alias("col_no"), F.col("id").cast("string").alias("value"), F.lit("plain").alias("style"))
    large = spark.range(1, 30_000).select(F.lit("large.xlsx").alias("name"), F.lit("L").alias("sheet"), F.col("id").cast("int").alias("row_no"), F.lit(1).alias("col_no"), F.sha2(F.col("id").cast("string"), 512).alias("value"), F.lit("plain").alias("style"))
    out = tmp_path / "out"
    spreadsheets.save(workbook.files(c.where("id < 90").unionByName(large)), str(out), per_folder=10)
    spreadsheets.save(workbook.files(c.where("id >= 90")), str(out))
    assert sorted(p.name for p in out.iterdir()) == [*(f"{i}.xlsx" for i in range(90, 95)), "dealt", "large.xlsx"]
    assert sum(len(list(d.iterdir())) for d in (out / "dealt").iterdir()) == 90 and max(len(list(d.iterdir())) for d in (out / "dealt").iterdir()) <= 10
    back = spreadsheets.cells(spark, str(out), split_bytes=1 << 20)
    assert sorted((r.path.rsplit("/", 1)[1], r.row_no, r.value) for r in back.where("sheet = 'S'").collect()) == sorted((f"{i}.xlsx", 1, str(i)) for i in range(95))
    assert sorted((r.row_no, r.value) for r in back.where("sheet = 'L'").collect()) == sorted((r.row_no, r.value) for r in large.collect())
    bad = spark.createDataFrame([(f"{i}", b"x" if i != 7 else None) for i in range(12)], "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="content"):
        spreadsheets.save(bad, str(tmp_path / "bad"), per_folder=2)
    assert not (tmp_path / "bad").exists() or list((tmp_path / "bad").iterdir()) == []


def test_commit_lists_a_bounded_number_of_names_at_a_time(tmp_path):
    writer = spreadsheets.FileWriter({"path": f"{tmp_path}/out"})
    m = writer.write(iter([{"name": f"{i % 2400}.xlsx", "content": str(i).encode()} for i in range(2500)]))
    waiting = [len(list(d.iterdir())) for d in (tmp_path / "out").rglob("*") if d.is_dir()]
    assert max(waiting) <= 1000
    writer.commit([m, None])
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"{i}.xlsx": str(i + 2400 if i < 100 else i) for i in range(2400)}
