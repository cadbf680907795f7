"""Sources, sinks and incremental loads round trip."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from talentlake.operators import match, tables
from talentlake.sources import html, readers, sinks
from talentlake.streaming import ingest


def test_read_table_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    (tmp_path / "c.json").write_text('[{"id": "1"}, {"id": "2"}]')
    rows = readers.read_records(spark, f"{tmp_path}/a.csv").collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    assert readers.read_table(spark, f"{tmp_path}/b.jsonl").count() == readers.read_table(spark, f"{tmp_path}/c.json").count() == 2
    with pytest.raises(ValueError, match="unknown kind"):
        readers.read_table(spark, "x.orc2")


def test_latest_file(spark, tmp_path):
    (tmp_path / "old.csv").write_text("a\n1\n")
    time.sleep(1.1)
    (tmp_path / "new.csv").write_text("a\n2\n")
    assert readers.latest_file(spark, str(tmp_path), "*.csv").endswith("new.csv")
    assert readers.list_files(spark, str(tmp_path), ("csv",)).count() == 2


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>qty</t></si><si><r><t>ap</t></r><r><t>ple</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   f'<row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2"><v>3</v></c></row><row r="3"><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/t.xlsx").collect()] == [("apple", "3"), (None, "x")]


def test_json_reports_skip_broken_files(spark, tmp_path):
    (tmp_path / "k1_gap.json").write_text(json.dumps({"missing": ["a"]}))
    (tmp_path / "k2_gap.json").write_text("{broken")
    rows = readers.json_reports(spark, str(tmp_path), "missing array<string>").collect()
    assert [(r["cv_key"], r["missing"]) for r in rows] == [("k1", ["a"])]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    sinks.save_table(old, f"{tmp_path}/t")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, version int")
    merged = sinks.merge_latest(spark, f"{tmp_path}/t", new, ["k"], F.col("version").desc())
    assert sorted((r.k, r.v) for r in merged.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.save_table(merged, f"{tmp_path}/staging")
    sinks.promote(spark, f"{tmp_path}/staging", f"{tmp_path}/t", f"{tmp_path}/snapshot")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert spark.read.parquet(f"{tmp_path}/snapshot").count() == 2
    sinks.run_log(spark, f"{tmp_path}/runs", "load", "ok", {"rows": "3"})
    assert spark.read.parquet(f"{tmp_path}/runs").first()["metadata"] == {"rows": "3"}
    sinks.replace_partitions(old, f"{tmp_path}/p", "k")
    sinks.replace_partitions(new.where("k = 2"), f"{tmp_path}/p", "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, "a"), (2, "c")]


def test_labelled_fields(spark):
    page = "<div>Location: Paris</div><p>Deadline</p><p>1/2/2026</p><h2>Description</h2><ul><li>one<li>two<li>one</ul><h2>Benefits</h2><p>x</p>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    out = {r.page_id: r.fields for r in html.extract_fields(df, "page_id", {"place": ["location"], "deadline": ["deadline"]}, {"description": ["description"], "benefits": ["benefits"]}).collect()}
    assert out[1] == {"place": "Paris", "deadline": "1/2/2026", "description": "one\ntwo", "benefits": "x"}
    assert out[2] == {}
    assert spark.range(1).select(html.page_count(F.lit("Found 1,021 jobs")).alias("n")).first()["n"] == 21


def test_incremental_load(spark, tmp_path):
    schema = "k int, v string, version int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.load_latest(ingest.stream_table(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", ["k"], "version", f"{tmp_path}/cp").awaitTermination()
    assert [(r.k, r.v) for r in ingest.read_latest(spark, f"{tmp_path}/out", ["k"], "version").collect()] == [(1, "b")]


def test_hybrid_tie_prefers_both_lists(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.1)], "job_id int, vector_score double")
    g = spark.createDataFrame([(2, 0.8), (3, 0.4)], "job_id int, graph_score double")
    out = match.hybrid_rank(v, g, "job_id", 0.5, 0.5).orderBy("rank").collect()
    assert [r.job_id for r in out] == [2, 1, 3]
    empty = v.limit(0)
    assert [r.job_id for r in match.hybrid_rank(empty, g, "job_id", 0.5, 0.5).orderBy("rank").collect()] == [2, 3]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        tables.require_columns(spark.range(1).toDF("a"), ["a", "b"])


def test_label_contract(spark):
    from talentlake.operators import refdata

    schema = "cv_id long, final_label_score double, grade string, subscore_skill double, subscore_experience double, subscore_achievement double, subscore_education double, subscore_formatting double, subscore_keywords double, label_source string, label_confidence double"
    rows = [(1, 75.0, "B", 24.0, 18.0, 12.0, 8.0, 9.0, 4.0, "human", 0.9), (2, 75.0, "A", 35.0, 18.0, 12.0, 8.0, 9.0, 4.0, "human", 1.2), (3, 75.0, "B", 24.0, 18.0, 12.0, 8.0, 9.0, 4.0, "human", 0.9)]
    errors = refdata.label_errors(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (2,)], "cv_id long"), ["human"])
    by_id = {i: {r.error for r in errors.collect() if r.cv_id == i} for i in (1, 2, 3)}
    assert by_id[1] == set()
    assert {"grade does not fit the score", "skill out of bounds", "confidence out of bounds", "subscores do not add up"} == by_id[2]
    assert by_id[3] == {"no such record"}


def test_cases_from_profiles(spark):
    from talentlake.operators import refdata

    profiles = spark.createDataFrame([("Data Analyst", ["sql", "excel"], ["python", "bi", "r"]), ("Tester", ["junit"], [])], "role_name string, common_skills array<string>, recommended_next_skills array<string>")
    files = spark.createDataFrame([("cv_data_analyst_01.txt",), ("cv_tester.txt",), ("cv_data.txt",)], "file string")
    out = {r.case_id: (r.file, r.expected_missing) for r in refdata.build_cases(profiles, files).collect()}
    assert out == {"case_data_analyst": ("cv_data_analyst_01.txt", ["python", "bi"]), "case_tester": ("cv_tester.txt", ["junit"])}


def test_records_are_normalised(spark):
    from talentlake.operators import refdata

    df = spark.createDataFrame([("unknown", "SQL, sql; Python|n/a")], "role string, skills string")
    r = refdata.normalise_record(df, ["skills"], ["role"]).first()
    assert (r.role, r.skills) == (None, ["SQL", "Python"])
