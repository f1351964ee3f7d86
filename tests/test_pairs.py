"""Paired exports: scan, join, orphans, sinks, streaming."""

import re

import pytest
from pyspark.sql import functions as F

from vaporlog.operators import joins
from vaporlog.plans.case_log import build_case_logs, case_log_from_table
from vaporlog.sources import columns, exports, sinks
from vaporlog.streaming.incremental import stream_case_logs

CASES = "MPOG_Case_ID,AIMS_Scheduled_DT,AIMS_Patient_Age_Years,ASA_Status,AIMS_Actual_Procedure_Text,AnesAttendings\n"
PROCS = "MPOG_Case_ID,ProcedureName,Comment,Details\n"


def write(folder, name, text):
    (folder / name).write_text(text)


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "DOE_JANE.Supervised.CaseList.csv", CASES
          + 'A,2025-01-01 08:00:00,45,2,Hip replacement,"DOE, JANE@2025-01-01 08:00:00"\n'
          + "B,2025-01-02 08:00:00,70,3,VATS lobectomy,\n")
    write(tmp_path, "DOE_JANE.Supervised.ProcedureList.csv", PROCS
          + "A,Unknown A,,\nA,LMA,easy,size 4\nA,Unknown B,,\nB,Peripheral nerve block,note,more\nX,Labor Epidural,,\n")
    write(tmp_path, "ROE_ANN.CaseList.csv", CASES + "X,2025-01-01,30,1,Knee,\n")
    write(tmp_path, "ROE_ANN.ProcedureList.csv", PROCS + "A,Femoral nerve block,,\n")
    write(tmp_path, "ONLY.CaseList.csv", CASES + "Z,2025-01-01,30,1,Knee,\n")
    return tmp_path


def test_scan_and_join(spark, folder):
    paired = exports.scan_pairs(spark, str(folder))
    assert [tuple(r) for r in paired.unpaired.collect()] == [("ONLY", "CaseList")]
    joined = {
        (r.pair_key, r.MPOG_Case_ID): (r.Airway_Type, r.Airway_Details)
        for r in joins.join_techniques(paired.cases, paired.procedures).collect()
    }
    assert joined == {
        ("DOE_JANE", "A"): ("LMA", "easy\nsize 4"),
        ("DOE_JANE", "B"): ("Peripheral nerve block", None),
        ("ROE_ANN", "X"): (None, None),
    }
    orphans = joins.orphan_procedures(paired.cases, paired.procedures)
    assert sorted((r.pair_key, r.MPOG_Case_ID) for r in orphans.collect()) == [("DOE_JANE", "X"), ("ROE_ANN", "A")]
    assert columns.normalize_orphans(orphans).select("age").distinct().first().age == "30"
    total = paired.procedures.count()
    assert joins.matched_procedures(paired.cases, paired.procedures).count() + orphans.count() == total


def test_null_ids_match_null_ids(spark):
    cases = spark.createDataFrame([("p", None), ("p", "1")], "pair_key string, MPOG_Case_ID string")
    procs = spark.createDataFrame(
        [("p", None, "LMA", 1), ("p", "2", "Spinal", 2)],
        "pair_key string, MPOG_Case_ID string, ProcedureName string, _seq long",
    )
    assert [r.MPOG_Case_ID for r in joins.orphan_procedures(cases, procs).collect()] == ["2"]
    assert joins.join_techniques(cases, procs).filter("MPOG_Case_ID IS NULL").first().Airway_Type == "LMA"


def test_no_pairs(spark, tmp_path):
    write(tmp_path, "A.CaseList.csv", CASES)
    write(tmp_path, "B.ProcedureList.csv", PROCS)
    with pytest.raises(ValueError, match="No matching CSV pairs"):
        exports.scan_pairs(spark, str(tmp_path))


def test_mixed_headers(spark, folder):
    write(folder, "ROE_ANN.ProcedureList.csv", "ProcedureName,MPOG_Case_ID\nFemoral nerve block,A\n")
    with pytest.raises(Exception, match="(?i)header"):
        exports.scan_pairs(spark, str(folder)).procedures.collect()
    mixed = exports.scan_pairs(spark, str(folder), mixed_layouts=True)
    rows = mixed.procedures.filter("pair_key = 'ROE_ANN'").select("MPOG_Case_ID", "ProcedureName").collect()
    assert [tuple(r) for r in rows] == [("A", "Femoral nerve block")]


def test_build_case_logs(spark, folder, tmp_path_factory):
    output = str(tmp_path_factory.mktemp("out") / "logs")
    result = build_case_logs(spark, str(folder), output)
    log = spark.read.parquet(f"{output}/case_log/data")
    assert log.count() == result.cases.count() == 3
    assert {r.resident for r in log.select("resident").collect()} == {"Jane Doe", "Ann Roe"}
    blocks = spark.read.parquet(f"{output}/standalone_blocks/data").collect()
    assert [b["Procedure Name"] for b in blocks] == ["Femoral nerve block"]
    meta = {r.key: r.value for r in spark.read.json(f"{output}/standalone_blocks/meta").collect()}
    assert (meta["version"], meta["format_type"]) == ("2", "standalone")
    with pytest.raises(Exception, match="(?i)exists"):
        build_case_logs(spark, str(folder), output)


def test_case_table_directory(spark, tmp_path):
    write(tmp_path, "a.csv", "Date,Episode ID,ASA\n2025-01-01,1,2\n")
    write(tmp_path, "b.csv", "Episode ID,Procedure\n2,Knee\n")
    table = exports.scan_case_tables(spark, str(tmp_path))
    assert "Services" in columns.missing_columns(table)
    log = {r["Case ID"]: r for r in case_log_from_table(table).collect()}
    assert log["1"]["ASA Physical Status"] == "2" and log["2"]["Original Procedure"] == "Knee"


def test_roster(spark):
    roster = spark.createDataFrame(
        [("Jane A. Smith (Jones)",), ('Robert "Bob" Stone',), ("Nobody Here",)], "name string"
    )
    available = spark.createDataFrame([("JANE JONES",), ("Jane Jones",), ("robert stone",)], "stem string")
    found = {r.name: (r.matched_stem, r.tried) for r in joins.match_roster(roster, available).collect()}
    assert found["Jane A. Smith (Jones)"] == (None, "Jane A. Smith; Jane Smith; Jones Smith")
    assert found['Robert "Bob" Stone'] == ("robert stone", "Robert Stone")
    assert found["Nobody Here"][0] is None


def test_hot_case_is_aggregated_before_the_shuffle(spark):
    procs = spark.range(1000).select(
        F.lit("p").alias("pair_key"), F.lit("hot").alias("MPOG_Case_ID"),
        F.when(F.col("id") == 500, "Spinal").otherwise("LMA").alias("ProcedureName"), F.col("id").alias("_seq"),
    )
    primary = joins.primary_techniques(procs)
    assert primary.first().Airway_Type == "Spinal"
    plan = primary._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_save_table_guard(spark, tmp_path):
    frame = spark.range(3)
    assert sinks.save_table(frame, str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_table(frame, str(tmp_path / "t"))
    assert sinks.save_table(frame, str(tmp_path / "t"), force=True).count() == 3


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.csv", "Date,Episode ID\n2025-01-01,1\nNA,2\n")
    schema = spark.read.option("header", True).csv(str(source)).schema
    for _ in range(2):
        stream_case_logs(spark, schema, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        write(source, "b.csv", "Date,Episode ID\n2025-01-03,3\n")
    log = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["Case ID"], r["Case Date"]) for r in log.collect()) == [
        ("1", "01/01/2025"), ("2", "01/01/2025"), ("3", "01/03/2025")
    ]


def test_quoted_cells_keep_line_breaks_and_quotes(spark, tmp_path):
    from vaporlog.sources.exports import read_csv

    (tmp_path / "a.csv").write_text('id,services,note\n1,"TRAUMA\nENT","said ""ETT 7"", ok"\n2,ENT,plain\n')
    rows = {r["id"]: (r["services"], r["note"]) for r in read_csv(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("TRAUMA\nENT", 'said "ETT 7", ok'), "2": ("ENT", "plain")}


def test_case_logs_have_one_file_per_small_resident(spark, tmp_path):
    log = spark.range(0, 400, 1, 16).select("id", F.concat(F.lit("r"), F.pmod("id", F.lit(10))).alias("resident"))
    sinks.write_case_logs(log, str(tmp_path / "log"))
    assert len(list((tmp_path / "log").rglob("*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path / "log")).select("id").exceptAll(log.select("id")).isEmpty()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_malformed_and_ragged_rows_are_rejected(spark, folder, tmp_path_factory):
    write(folder, "ROE_ANN.CaseList.csv", CASES + "X,2025-01-01,30,1,Knee,,one,two\nY,2025-01-02,31\nZ,2025-01-03,32,1,Hip,\"DOE, J@x\"\n")
    write(folder, "ROE_ANN.ProcedureList.csv", PROCS + 'Y,LMA,"left open,\nnever closed\n')
    paired = exports.scan_pairs(spark, str(folder))
    good, bad = exports.quarantine(paired.cases)
    assert {r.MPOG_Case_ID: (r.AIMS_Patient_Age_Years, r.ASA_Status) for r in good.filter("pair_key = 'ROE_ANN'").collect()} == {
        "Y": ("31", None), "Z": ("32", "1")}
    row = bad.first()
    assert bad.count() == 1 and (row.pair_key, row.source_text) == ("ROE_ANN", "X,2025-01-01,30,1,Knee,,one,two")
    assert (row.parsing_warnings, row.confidence_score) == (["Failed to process row: malformed record"], 0.0)
    assert good.select("MPOG_Case_ID").count() == 4 and "_corrupt_record" not in good.columns  # also with few columns
    output = str(tmp_path_factory.mktemp("out") / "logs")
    result = build_case_logs(spark, str(folder), output)
    found = sorted((r.pair_key, r.found_in, r.source_text.split(",")[0], str(r.case_date)) for r in result.rejects.collect())
    assert found == [("ROE_ANN", "CaseList", "X", "2025-01-01"), ("ROE_ANN", "ProcedureList", "Y", "2025-01-01")]
    assert spark.read.parquet(f"{output}/case_log/data").count() == 4
    assert spark.read.parquet(f"{output}/rejects").count() == 2
    rest = exports.quarantine(exports.read_csv(spark, f"{folder}/ROE_ANN.ProcedureList.csv", multi_line=False))
    assert [r.MPOG_Case_ID for r in rest[0].collect()] == ["never closed"]  # an open quote spoils one line only
    assert [r.source_text for r in rest[1].collect()] == ['Y,LMA,"left open,']


def test_pairs_come_from_the_listing(spark, folder, monkeypatch):
    opened = []
    monkeypatch.setattr(exports, "read_csv", lambda s, paths, *a: opened.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or s.createDataFrame(
        [(p,) for p in paths], "_file string"))
    paired = exports.scan_pairs(spark, str(folder))
    assert opened == [
        ["DOE_JANE.Supervised.CaseList.csv", "ROE_ANN.CaseList.csv"], ["DOE_JANE.Supervised.ProcedureList.csv", "ROE_ANN.ProcedureList.csv"]
    ]
    assert {r.pair_key for r in paired.cases.collect()} == {"DOE_JANE", "ROE_ANN"}
    opened.clear()
    exports.scan_pairs(spark, str(folder), where="pair_key = 'ROE_ANN'")
    assert opened == [["ROE_ANN.CaseList.csv"], ["ROE_ANN.ProcedureList.csv"]]
    plan = plan_of(exports.list_files(spark, str(folder)))
    assert "ReadSchema: struct<path:string>" in plan and "content" not in plan


def test_exports_written_by_spark_are_folders(spark, tmp_path):
    cases = spark.createDataFrame([("A 1+%", "C1", "x,\n\"y\""), ("B", "C2", None)], "pair_key string, MPOG_Case_ID string, AIMS_Actual_Procedure_Text string")
    for suffix in ("CaseList", "ProcedureList"):
        named = cases.select(F.concat("pair_key", F.lit(f".{suffix}.csv")).alias("export"), "MPOG_Case_ID", "AIMS_Actual_Procedure_Text")
        named.write.partitionBy("export").option("header", True).option("escape", '"').mode("append").csv(str(tmp_path))
    paired = exports.scan_pairs(spark, str(tmp_path))
    rows = {r.MPOG_Case_ID: r.AIMS_Actual_Procedure_Text for r in paired.cases.collect()}
    assert rows == {"C1": 'x,\n"y"', "C2": None}
    assert paired.unpaired.count() == 0


def test_headers_cost_one_record_per_file(spark, tmp_path):
    write(tmp_path, "a.csv", '﻿id,"two\nlines",,id,ID\n' + "1,2,3,4,5\n" * 50_000)
    write(tmp_path, "b.csv", "")
    write(tmp_path, "c.csv", "other")
    found = {r.path.rsplit("/", 1)[1]: r.header for r in exports.scan_headers(exports.list_files(spark, str(tmp_path))).collect()}
    assert found == {"a.csv": '["id", "two\\nlines", "", "id", "ID"]', "c.csv": '["other"]'}
    table = exports.read_csv(spark, str(tmp_path), mixed_layouts=True)
    assert table.columns[:6] == ["id", "two\nlines", "_c2", "id.1", "ID.2", "_corrupt_record"]
    assert table.count() == 50_000
    declared = exports.read_csv(spark, f"{tmp_path}/c.csv", header=["other"])
    assert declared.columns[0] == "other" and declared.count() == 0
    with pytest.raises(Exception, match="(?i)header"):
        exports.read_csv(spark, f"{tmp_path}/a.csv", header=["id", "x", "y", "z", "w"]).collect()


def test_filters_reach_the_scan_below_the_annotation(spark, tmp_path):
    from vaporlog.operators.annotate import annotate
    from vaporlog.plans.case_log import parse_pairs

    path = str(tmp_path / "cases")
    spark.createDataFrame([("p", "E1", 1), ("q", "E2", 2)], "pair_key string, `Episode ID` string, seq long").write.partitionBy("pair_key").parquet(path)
    table = spark.read.parquet(path)
    mapped = columns.map_columns(table, keep=["pair_key", "seq"])
    log = annotate(mapped, where="pair_key = 'q' AND seq > 1")
    assert [r.episode_id for r in log.collect()] == ["E2"]
    plan = plan_of(log)
    assert "PartitionFilters: [isnotnull(pair_key" in plan and "(pair_key#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThan(seq,1)" in plan
    plan = plan_of(case_log_from_table(table, where=F.col("pair_key") == "q"))
    assert "PartitionFilters: [isnotnull(pair_key" in plan
    lists = table.select("pair_key", F.col("Episode ID").alias("MPOG_Case_ID"), F.lit("LMA").alias("ProcedureName"), F.col("seq").alias("_seq"))
    result = parse_pairs(lists, lists, where="pair_key = 'p'")
    for frame in (result.case_log(), result.block_log(), result.neuraxial_log()):
        scans = plan_of(frame).split("PartitionFilters: ")[1:]
        assert scans and all(scan.startswith("[isnotnull(pair_key") for scan in scans)
    assert [r["Case ID"] for r in result.case_log().collect()] == ["E1"]


def test_orphans_are_found_without_sorting_procedures(spark):
    cases = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", None), ("q", "3")], "pair_key string, MPOG_Case_ID string")
    procedures = spark.createDataFrame([("p", "1", 1), ("p", None, 2), ("p", "2", 3), ("p", "3", 4), ("q", None, 5)], "pair_key string, MPOG_Case_ID string, _seq int")
    for found, rows in ((joins.orphan_procedures(cases, procedures), {3, 4, 5}), (joins.matched_procedures(cases, procedures), {1, 2})):
        assert {r["_seq"] for r in found.collect()} == rows and found.count() == len(rows)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_pair_key_by_plain_cuts(spark):
    """The key of any path, as a pattern finds it, without a search in every row."""
    pattern = re.compile(r"([^/=]*?)(?:\.Supervised)?\.CaseList\.csv(?:/[^/]*)?$")
    heads = ("", "/", "file:/a=b/", "s3://x/A.CaseList.csv/B/", "/d/export=", "=", "/a/b=c=")
    names = ("DOE_JANE", "A.Supervised", "A.Supervised.Supervised", ".Supervised", "Supervised", "", "Ärzte 1+%", "A.CaseList.csv")
    tails = (".CaseList.csv", ".CaseList.csv/part-0.csv", ".CaseList.csv/", ".CaseList.csv/b/c", ".ProcedureList.csv", "CaseList.csv", ".CaseList.csv.gz")
    paths = [head + name + tail for head in heads for name in names for tail in tails] + [None, "", "/"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", exports.pair_key(F.col("path"), "CaseList").alias("key"))
    for path, key in rows.collect():
        found = None if path is None else pattern.search(path)
        assert key == (None if path is None else found.group(1) if found else ""), path
    assert "regexp" not in rows._jdf.queryExecution().executedPlan().toString().lower()


def test_lists_are_not_sorted_by_their_few_pairs(spark):
    """The keys of pairs are few however long the lists are: no list is shuffled to compare them."""
    lists = [spark.range(1000000).selectExpr(f"'R' || (id % {n}) AS pair_key", "id AS seq") for n in (40, 41)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        paired = exports.pair_up(*lists)
        plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in (paired.cases, paired.procedures)]
        assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in plans)
        assert paired.procedures.filter("pair_key = 'R40'").count() == 0 and paired.cases.count() == 1000000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [tuple(r) for r in paired.unpaired.collect()] == [("R40", "ProcedureList")]
