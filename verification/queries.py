"""One Spark query per operator of the inventory, over whole derived views."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporlog.functions import text as X
from vaporlog.functions.staging import computed_once, new_path, written_once
from vaporlog.operators import basics, blocks, categorize, curate, features, findings, hybrid, joins, models, project, quality
from vaporlog.operators import queue as Q
from vaporlog.operators import review as R
from vaporlog.operators.annotate import annotate
from vaporlog.plans import training as plans
from vaporlog.plans.case_log import parse_pairs
from vaporlog.rules import procedures as P
from vaporlog.rules import schema as S
from vaporlog.sources import columns, exports, sinks
from verification.views import view

QUERIES = {}


def query(function):
    """Register a query under its function name."""
    QUERIES[function.__name__] = function
    return function


# --- inputs -------------------------------------------------------------------------

CASE_EXPORT = {
    "case_id": "MPOG_Case_ID", "scheduled_dt": "AIMS_Scheduled_DT", "patient_age": "AIMS_Patient_Age_Years",
    "asa_status": "ASA_Status", "procedure_text": "AIMS_Actual_Procedure_Text", "attendings": "AnesAttendings",
}
PROC_EXPORT = {
    "case_id": "MPOG_Case_ID", "scheduled_dt": "AIMS_Scheduled_DT", "asa_status": "ASA_Status",
    "emergency": "Emergency", "procedure_name": "ProcedureName", "primary_block": "PrimaryBlock",
    "comment": "Comment", "details": "Details", "procedure_text": "AIMS_Actual_Procedure_Text",
    "attendings": "AnesAttendingNames",
}


def case_table(spark, sf):
    return view(spark, sf, "case_table")


def case_list(spark, sf):
    return view(spark, sf, "case_list").withColumnsRenamed({**CASE_EXPORT, "seq": "_seq"})


def proc_list(spark, sf):
    return view(spark, sf, "proc_list").withColumnsRenamed({**PROC_EXPORT, "seq": "_seq"})


def parsed(spark, sf):
    return annotate(case_table(spark, sf))


def paired(spark, sf):
    lists = exports.pair_up(case_list(spark, sf), proc_list(spark, sf))
    return parse_pairs(lists.cases, lists.procedures)


def ruled(spark, sf):
    table = case_table(spark, sf)
    return categorize.categorize(table.withColumn("services", X.split_lines(F.col("services"))))


def scored(spark, sf):
    """Rule categories with model predictions and the hybrid decision."""
    guesses = view(spark, sf, "predictions")
    return hybrid.fuse(ruled(spark, sf).select("seq", "procedure", "rule_category", "rule_warnings").join(guesses, "seq"))


def compared(spark, sf):
    return Q.side_by_side(scored(spark, sf), label="human_category")


def prepared(spark, sf):
    return curate.prepare(computed_once(view(spark, sf, "training_rows")))


def overrides(spark, sf):
    return curate.override_map(view(spark, sf, "review_labels"))


def parts(spark, sf):
    return curate.split_seen_unseen(prepared(spark, sf).select("seq", "procedure", "rule_category"))


def assessed(spark, sf):
    # A case without an id gets a content hash, which only Spark can repeat: give it a plain one here. Findings with their
    # contexts are in that hash alone.
    cases = parsed(spark, sf).drop("extraction_findings").withColumn("source_file", F.concat("pair_key", F.lit(".CaseList.csv")))
    return R.assess(cases.withColumn(
        "episode_id",
        F.coalesce(F.nullif(F.col("episode_id"), F.lit("")), F.concat(F.lit("row-"), F.col("seq"))),
    ))


# --- sources ------------------------------------------------------------------------


def new_folder(spark):
    """A folder of the shared one for the files of one query; removed with the driver."""
    return new_path(spark, "query")


def csv_writer(rows):
    """Cells are written as they are, with doubled quotes."""
    writer = rows.write.option("header", True).option("escape", '"')
    return writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def written_lists(spark, sf):
    """Both lists as CSV exports, a folder of part files for each list of a pair."""
    folder = new_folder(spark)
    for rows, suffix in ((case_list(spark, sf), exports.CASE_SUFFIX), (proc_list(spark, sf), exports.PROCEDURE_SUFFIX)):
        named = rows.withColumn("export", F.concat("pair_key", F.lit(f".{suffix}.csv"))).drop("pair_key", "_seq")
        csv_writer(named.hint("rebalance", "export")).mode("append").partitionBy("export").csv(folder)
    return folder


@query
def s1_paired_exports(spark, sf):
    lists = exports.scan_pairs(spark, written_lists(spark, sf))
    kept = lists.cases.groupBy("pair_key").agg(F.count(F.lit(1)).alias("case_rows"))
    procs = lists.procedures.groupBy("pair_key").agg(F.count(F.lit(1)).alias("procedure_rows"))
    return kept.join(procs, "pair_key")


@query
def s1_unpaired_exports(spark, sf):
    return exports.scan_pairs(spark, written_lists(spark, sf)).unpaired


@query
def s2_united_case_tables(spark, sf):
    first = case_list(spark, sf).select("pair_key", "MPOG_Case_ID", "ASA_Status")
    second = proc_list(spark, sf).select("pair_key", "MPOG_Case_ID", "Emergency")
    return first.unionByName(second, allowMissingColumns=True)


@query
def s2_scanned_case_tables(spark, sf):
    """Case tables of two layouts written as CSV and read by name."""
    folder = new_folder(spark)
    csv_writer(case_list(spark, sf).select("pair_key", "MPOG_Case_ID", "ASA_Status")).csv(f"{folder}/first")
    csv_writer(proc_list(spark, sf).select("Emergency", "MPOG_Case_ID", "pair_key", "Details")).csv(f"{folder}/second")
    return exports.scan_case_tables(spark, f"{folder}/*").select("pair_key", "MPOG_Case_ID", "ASA_Status", "Emergency", "Details")


@query
def s7_written_case_logs(spark, sf):
    """The case log written by resident, with its format beside it, and read back."""
    folder = new_folder(spark)
    named = project.resident_names(paired(spark, sf).case_log()).drop("pair_key", "resident_id")
    sinks.write_with_metadata(named, folder, "caselog")
    return spark.read.parquet(f"{folder}/data").select("resident", *S.CASE_LOG_COLUMNS)


@query
def s8_format_metadata(spark, sf):
    """Rows and residents of a written standalone log, with the version and layout that its metadata names."""
    folder = new_folder(spark)
    named = project.resident_names(paired(spark, sf).standalone.select("pair_key", "episode_id", "procedure_category"))
    sinks.write_with_metadata(named.drop("pair_key", "resident_id"), folder, "standalone")
    meta = spark.read.json(f"{folder}/meta").filter("key <> 'generated'")
    meta = meta.agg(*[F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in ("version", "format_type")])
    named = meta.first()
    log = spark.read.parquet(f"{folder}/data")
    return log.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("resident").alias("residents"),
        F.lit(named["version"]).alias("version"), F.lit(named["format_type"]).alias("format_type"),
    )


@query
def s9_saved_training_rows(spark, sf):
    """Prepared rows written once, refused a second time, replaced by force, and read back."""
    folder = f"{new_folder(spark)}/prepared"
    rows = prepared(spark, sf).select("seq", "rule_category", "warnings")
    sinks.save_table(rows, folder)
    try:
        sinks.save_table(rows, folder)
    except AnalysisException:
        return sinks.save_table(rows, folder, force=True)
    raise ValueError("a table was replaced without force")


@query
def p24_quarantined_rows(spark, sf):
    """Case lists with damaged lines, written as text and scanned: good rows by id, rejected ones by their text."""
    cells = ("MPOG_Case_ID", "AIMS_Scheduled_DT", "AIMS_Patient_Age_Years", "ASA_Status", "AIMS_Actual_Procedure_Text", "AnesAttendings")
    whole = F.concat_ws(",", *[F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"'))) for c in cells])
    kind = F.col("_seq") % 50
    line = (
        F.when(kind == 0, F.concat(whole, F.lit(',"two cells",more')))
        .when(kind == 20, F.concat("MPOG_Case_ID", F.lit(',"left open')))
        .when(kind == 10, F.concat_ws(",", "MPOG_Case_ID", F.lit("short")))
        .otherwise(whole)
    )
    folder = new_folder(spark)
    lines = case_list(spark, sf).select(F.concat("pair_key", F.lit(".CaseList.csv")).alias("export"), line.alias(",".join(cells)))
    raw_text = lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0002").option("ignoreTrailingWhiteSpace", False)
    raw_text.partitionBy("export").csv(folder)
    scanned = exports.read_csv(spark, f"{folder}/*.CaseList.csv", multi_line=False)
    good, rejects = exports.quarantine(scanned.withColumn("pair_key", exports.pair_key(F.col("_file"), exports.CASE_SUFFIX)))
    return good.select("pair_key", F.col("MPOG_Case_ID").alias("case_id"), F.col("AIMS_Scheduled_DT").alias("text"), F.lit("").alias("warning")).unionByName(
        rejects.select("pair_key", F.lit(None).cast("string").alias("case_id"), F.col("source_text").alias("text"), F.array_join("parsing_warnings", "; ").alias("warning"))
    )


@query
def s3_mapped_columns(spark, sf):
    export = case_list(spark, sf)
    names = {"episode_id": "MPOG_Case_ID", "date": "AIMS_Scheduled_DT", "asa": "ASA_Status"}
    missing = ", ".join(columns.missing_columns(export, names))
    return columns.map_columns(export, names).withColumn("missing_columns", F.lit(missing))


@query
def s4_normalized_cases(spark, sf):
    joined = joins.join_techniques(case_list(spark, sf), proc_list(spark, sf))
    return columns.normalize_cases(joined, keep=["pair_key"])


@query
def s5_normalized_orphans(spark, sf):
    orphans = joins.orphan_procedures(case_list(spark, sf), proc_list(spark, sf))
    return columns.normalize_orphans(orphans, keep=["pair_key"])


@query
def s6_service_alias(spark, sf):
    rows = view(spark, sf, "training_rows").select(
        "seq", "service_text", F.col("procedure").alias("services"), F.col("file").alias("Service")
    )
    return columns.coalesce_services(rows, "resolved").select("seq", "resolved")


# --- joins --------------------------------------------------------------------------


@query
def w1_primary_technique(spark, sf):
    return joins.primary_techniques(proc_list(spark, sf))


@query
def j1_cases_with_technique(spark, sf):
    joined = joins.join_techniques(case_list(spark, sf), proc_list(spark, sf))
    return joined.select("pair_key", "MPOG_Case_ID", "Airway_Type", "Airway_Details")


@query
def j2_orphan_procedures(spark, sf):
    orphans = joins.orphan_procedures(case_list(spark, sf), proc_list(spark, sf))
    return orphans.select("pair_key", "MPOG_Case_ID", "_seq", "ProcedureName").withColumnRenamed("_seq", "seq")


@query
def j3_matched_procedures(spark, sf):
    matched = joins.matched_procedures(case_list(spark, sf), proc_list(spark, sf))
    return matched.select("pair_key", "MPOG_Case_ID", "_seq", "ProcedureName").withColumnRenamed("_seq", "seq")


@query
def j4_roster_match(spark, sf):
    return joins.match_roster(view(spark, sf, "roster"), view(spark, sf, "available_logs"))


@query
def j5_override_lookup(spark, sf):
    rows = prepared(spark, sf).select("seq", "procedure", "rule_category")
    return curate.apply_overrides(rows, overrides(spark, sf))


@query
def j6_unreviewed_rows(spark, sf):
    reviewed = view(spark, sf, "review_labels").select(
        "seq",
        F.when(F.col("seq") % 3 == 0, "data-a").otherwise("data-b").alias("data_id"),
        F.when(F.col("seq") % 2 == 0, "model-1").otherwise("model-2").alias("model_id"),
    )
    rows = compared(spark, sf).select("seq", "ml_prediction", "disagreement")
    return Q.exclude_reviewed(rows, reviewed, "data-a", "model-1")


@query
def j7_predictions_side_by_side(spark, sf):
    return compared(spark, sf).select(
        "seq", "rule_prediction", "ml_prediction", "hybrid_prediction", "label", "disagreement"
    )


# --- annotation ---------------------------------------------------------------------


@query
def p1_case_dates(spark, sf):
    dated = basics.parse_dates(case_table(spark, sf))
    return dated.select("seq", F.date_format("case_date", "yyyy-MM-dd").alias("case_date"), "date_warning")


@query
def p2_age_bands(spark, sf):
    return basics.band_ages(case_table(spark, sf)).select("seq", "age_category", "age_warning")


@query
def p3_asa_status(spark, sf):
    return basics.complete_asa(case_table(spark, sf)).select("seq", "emergent", "asa_physical_status", "asa_warning")


@query
def p4_anesthesia_mapping(spark, sf):
    return basics.map_anesthesia(case_table(spark, sf)).select("seq", "mapped_anesthesia", "anesthesia_warning")


@query
def p5_anesthesia_inference(spark, sf):
    return parsed(spark, sf).select("seq", "anesthesia_type")


@query
def p6_procedure_category(spark, sf):
    return ruled(spark, sf).select(
        "seq", "rule_category", F.array_join("rule_warnings", "; ").alias("rule_warnings")
    )


def _surgery(spark, sf):
    table = case_table(spark, sf).withColumn("procedure_upper", F.coalesce(F.upper("procedure"), F.lit("")))
    return categorize.add_specific_categories(table)


@query
def p7_cardiac_split(spark, sf):
    return _surgery(spark, sf).select("seq", "cardiac_category")


@query
def p8_approach(spark, sf):
    return _surgery(spark, sf).select("seq", "approach")


@query
def p9_pathology(spark, sf):
    return _surgery(spark, sf).select("seq", "pathology")


@query
def p10_family_categories(spark, sf):
    return _surgery(spark, sf).select("seq", "vessel_category", "intracerebral_category", "obgyn_category")


@query
def p11_airway_findings(spark, sf):
    found = findings.airway_findings(case_table(spark, sf))
    return found.select("seq", F.explode("airway_findings").alias("f")).select("seq", "f.value", "f.confidence")


@query
def p12_vascular_findings(spark, sf):
    found = findings.vascular_findings(case_table(spark, sf))
    return found.select("seq", F.explode("vascular_findings").alias("f")).select("seq", "f.value", "f.confidence")


@query
def p13_monitoring_values(spark, sf):
    return parsed(spark, sf).select("seq", F.array_join("monitoring", "; ").alias("monitoring"))


@query
def p14_finding_contexts(spark, sf):
    cases = findings.all_findings(case_table(spark, sf))
    return findings.findings_table(cases, ["seq"]).select("seq", "value", "source_field", "context")


@query
def p15_note_corpus_findings(spark, sf):
    notes = view(spark, sf, "note_corpus").withColumn("procedure", F.lit(None).cast("string"))
    rows = findings.findings_table(findings.all_findings(notes), ["seq"])
    return rows.select("seq", "value", "confidence", "context")


@query
def p16_case_confidence(spark, sf):
    return parsed(spark, sf).select("seq", F.round("confidence_score", 6).alias("confidence_score"))


@query
def p17_block_sites(spark, sf):
    return parsed(spark, sf).select("seq", "nerve_block_type")


@query
def p18_thoracic_bands(spark, sf):
    terms = F.split("nerve_block_type", "; ")
    return parsed(spark, sf).select(
        "seq",
        F.coalesce(F.array_contains(terms, "T 1-7"), F.lit(False)).alias("upper_band"),
        F.coalesce(F.array_contains(terms, "T 8-12"), F.lit(False)).alias("lower_band"),
    )


@query
def p19_unmatched_blocks(spark, sf):
    return parsed(spark, sf).select("seq", "unmatched_block_source")


@query
def p20_warnings(spark, sf):
    return parsed(spark, sf).select("seq", F.array_join("parsing_warnings", " | ").alias("warnings"))


@query
def p21_case_log(spark, sf):
    return project.case_log(parsed(spark, sf), keep=["seq"])


@query
def p22_standalone_log(spark, sf):
    return project.standalone_log(paired(spark, sf).standalone, keep=["pair_key"])


@query
def p23_airway_flags(spark, sf):
    return project.airway_flags(parsed(spark, sf)).select("seq", "has_double_lumen_tube", "tube_route", "ga_mac")


@query
def p25_review_scores(spark, sf):
    return assessed(spark, sf).select(
        "seq", "score_double_lumen", "score_tube_route", "score_ga_mac",
        F.round("score_control", 6).alias("score_control"),
        F.array_join("review_targets", "; ").alias("review_targets"),
        F.array_join("review_reasons", "; ").alias("review_reasons"),
    )


@query
def p26_review_records(spark, sf):
    return R.records(assessed(spark, sf))


@query
def p26_case_keys(spark, sf):
    """Keys of all cases; those without an id have a hash of all their columns in it."""
    cases = case_table(spark, sf).withColumn("source_file", F.concat("pair_key", F.lit(".CaseList.csv")))
    return R.case_keys(cases).select("seq", "case_key")


@query
def p27_label_normalization(spark, sf):
    labels = view(spark, sf, "review_labels")
    return labels.select(
        "seq",
        curate.normalize_label(F.col("human_category")).alias("label"),
        curate.optional_label(F.col("human_category")).alias("optional_label"),
    )


@query
def p28_resident_names(spark, sf):
    return project.resident_names(case_list(spark, sf).select("pair_key").distinct())


@query
def n1_n7_text_expressions(spark, sf):
    rows = case_table(spark, sf)
    return rows.select(
        "seq",
        X.join_distinct(F.col("procedure"), F.col("services"), F.col("procedure")).alias("joined"),
        X.provider_name(F.col("anesthesiologist")).alias("provider"),
        X.first_attending(F.col("anesthesiologist")).alias("attending"),
        X.strip_phi(F.concat(F.lit("[PHI] "), "procedure", F.lit("  [PHI]"))).alias("without_phi"),
        X.procedure_key(F.col("procedure_notes")).alias("key"),
        F.substring("episode_id", 1, S.EPISODE_ID_LENGTH).alias("episode_id"),
        X.missing_to_null(F.col("nerve_block_type")).alias("block"),
        X.parse_int(F.col("asa")).alias("asa_number"),
    )


# --- filters and routing ------------------------------------------------------------


@query
def f1_problematic_cases(spark, sf):
    return quality.problematic_cases(parsed(spark, sf)).select("seq")


@query
def f2_low_confidence(spark, sf):
    return quality.low_confidence_cases(parsed(spark, sf)).select("seq")


@query
def f3_missing_fields(spark, sf):
    rows = quality.with_missing_fields(parsed(spark, sf))
    return rows.select("seq", F.array_join("missing_fields", ", ").alias("missing_fields"))


@query
def f4_standalone_routes(spark, sf):
    routed = paired(spark, sf).standalone
    return routed.select("pair_key", "episode_id", "seq", "route")


@query
def f5_disagreements(spark, sf):
    return Q.disagreements(compared(spark, sf))


@query
def f6_review_focus(spark, sf):
    return Q.focus_filter(compared(spark, sf)).select("seq", "ml_confidence", "disagreement")


@query
def f7_training_rows(spark, sf):
    return prepared(spark, sf).select("seq", "file", "procedure", "service_text", "rule_category", "warnings")


# --- windows, samples, top-k --------------------------------------------------------


@query
def w2_keep_last_labels(spark, sf):
    return curate.keep_last(
        view(spark, sf, "review_labels").filter(F.col("procedure").isNotNull()).select("procedure", "human_category", "seq"),
        "procedure",
    )


@query
def w3_bucket_candidates(spark, sf):
    best = R.candidates(assessed(spark, sf).filter(F.size("review_targets") > 0))
    return best.select("bucket", "seq", F.col("rank").cast("long").alias("rank"))


@query
def w4_bucket_quotas(spark, sf):
    # Room for one review case per hundred cases.
    room = case_table(spark, sf).count() // 100
    return spark.createDataFrame(list(R.bucket_quotas(room).items()), "bucket string, quota long")


@query
def w5_review_selection(spark, sf):
    best = R.candidates(assessed(spark, sf).filter(F.size("review_targets") > 0))
    return R.select_cases(best).select("case_key", "bucket", F.round("score", 6).alias("score"), "seq")


@query
def w6_sample_per_file(spark, sf):
    return curate.sample_per_file(view(spark, sf, "training_rows"), 100).select("seq", "file")


@query
def w7_value_sample(spark, sf):
    return curate.sample_by_value(prepared(spark, sf), 4000).select("seq", "tier")


@query
def w8_seen_unseen_split(spark, sf):
    return curate.split_seen_unseen(prepared(spark, sf)).select("seq", "rule_category", "part")


@query
def w10_review_queue(spark, sf):
    rows = Q.focus_filter(compared(spark, sf))
    return Q.review_queue(rows).select("seq", "ml_confidence", "disagreement")


@query
def w11_top_warnings(spark, sf):
    return quality.top_warnings(parsed(spark, sf))


@query
def w12_first_problems(spark, sf):
    rows = quality.first_problems(parsed(spark, sf))
    return rows.select("seq", "episode_id", F.array_join("missing_fields", ", ").alias("missing_fields"), "more")


# --- aggregates ---------------------------------------------------------------------


@query
def a1_validation_summary(spark, sf):
    return quality.summary(parsed(spark, sf))


@query
def a2_warning_histogram(spark, sf):
    return quality.warning_counts(parsed(spark, sf))


@query
def a3_missing_field_counts(spark, sf):
    return quality.missing_field_counts(parsed(spark, sf))


@query
def a4_extraction_rates(spark, sf):
    return quality.extraction_rates(parsed(spark, sf))


@query
def a5_extraction_values(spark, sf):
    return quality.extraction_values(parsed(spark, sf))


@query
def a6_validation_table(spark, sf):
    return quality.case_table(parsed(spark, sf), keep=["seq"])


@query
def a7_json_report(spark, sf):
    """The report's payloads read as JSON again."""
    numbers = ("total_cases", "cases_with_warnings", "low_confidence_cases", "occurrences", "missing", "cases", "warning_count")
    shape = "average_confidence double, rate double, confidence_score double, is_low_confidence boolean, has_warnings boolean, "
    shape += ", ".join(f"{name} long" for name in numbers) + ", warning string, field string, family string, value string, case_id string, "
    shape += "warnings array<string>, missing_fields array<string>"
    read = quality.report_rows(parsed(spark, sf)).select("section", F.from_json("payload", shape).alias("x"))
    return read.select(
        "section", F.coalesce("x.warning", "x.field", "x.family", "x.case_id").alias("name"), "x.value",
        F.coalesce("x.total_cases", "x.occurrences", "x.missing", "x.cases", "x.warning_count").alias("n"),
        "x.cases_with_warnings", "x.low_confidence_cases", "x.has_warnings", "x.is_low_confidence",
        F.round(F.coalesce("x.average_confidence", "x.rate", "x.confidence_score"), 6).alias("score"),
        F.array_join("x.warnings", " | ").alias("warnings"), F.array_join("x.missing_fields", ", ").alias("missing_fields"),
    )


@query
def a8_output_summary(spark, sf):
    return quality.output_summary(project.case_log(parsed(spark, sf)))


@query
def a9_category_distribution(spark, sf):
    return curate.category_distribution(prepared(spark, sf))


@query
def a10_file_stats(spark, sf):
    return curate.file_stats(view(spark, sf, "training_rows"))


@query
def a11_resident_summary(spark, sf):
    return paired(spark, sf).run_summary()


@query
def a12_a13_confidence_bins(spark, sf):
    return Q.confidence_bins(compared(spark, sf))


@query
def a14_labeled_accuracy(spark, sf):
    return Q.labeled_accuracy(compared(spark, sf))


@query
def a15_classification_report(spark, sf):
    return Q.classification_report(compared(spark, sf).filter("label <> ''"))


@query
def a15_confusion_matrix(spark, sf):
    return Q.confusion_matrix(compared(spark, sf).filter("label <> ''"))


@query
def a16_override_summary(spark, sf):
    return curate.merge_summary(parts(spark, sf), overrides(spark, sf))


@query
def a17_review_bucket_counts(spark, sf):
    return R.bucket_counts(R.review_set(assessed(spark, sf).filter(F.size("review_targets") > 0)))


# --- sets and shapes ----------------------------------------------------------------


@query
def u1_union_of_pairs(spark, sf):
    result = paired(spark, sf)
    fields = ["pair_key", "episode_id", "procedure_category"]
    return (
        result.cases.select(*fields, F.lit("case").alias("kind"))
        .unionByName(result.standalone.select(*fields, "route", F.lit("standalone").alias("kind")), allowMissingColumns=True)
    )


@query
def u2_u3_retrain_rows(spark, sf):
    retrain, _ = curate.merge_overrides(parts(spark, sf), overrides(spark, sf))
    return retrain.select("procedure_key", "rule_category", "corrected", "copy")


@query
def u2_remaining_unseen(spark, sf):
    _, remaining = curate.merge_overrides(parts(spark, sf), overrides(spark, sf))
    return remaining.select("seq", "procedure", "rule_category")


@query
def u4_services_by_row(spark, sf):
    rows = case_table(spark, sf).select("seq", F.posexplode(X.split_lines(F.col("services"))).alias("position", "service"))
    return rows


@query
def u5_findings_table(spark, sf):
    return findings.findings_table(parsed(spark, sf), ["seq"]).select(
        "seq", "position", "value", "confidence", "source_field"
    )


# --- model decisions ----------------------------------------------------------------


@query
def m9_hybrid_decision(spark, sf):
    return scored(spark, sf).select(
        "seq", "procedure_category", "method", "category_confidence", "alternative",
        F.array_join("category_warnings", " | ").alias("category_warnings"),
    )


@query
def m9_rules_only(spark, sf):
    return hybrid.rules_only(ruled(spark, sf)).select("seq", "procedure_category", "method", "category_confidence")


def seen_and_unseen(spark, sf):
    rows = prepared(spark, sf).select("seq", "procedure", "service_text", "rule_category")
    split = curate.split_seen_unseen(rows)
    return split.filter("part = 'seen'").drop("part"), split.filter("part = 'unseen'").drop("part")


@query
def m1_m4_text_vectors(spark, sf):
    inputs = features.feature_inputs(view(spark, sf, "training_rows").select("seq", "procedure", "service_text"))
    inputs = features.with_text(features.structured_features(inputs)).select("seq", "text", *features.structured_names())
    inputs = written_once(features.packed(inputs))  # several passes
    fitted, different = features.fit_different(inputs.drop("seq"))
    # Values in millionths: those of terms that a text has, in the order of the vocabulary, and the structured ones at the vector's end.
    size = len(features.structured_names())
    shown = features.different_vectors(fitted, features.with_key(fitted, different)).select(
        *features.KEY,
        *[millionths(F.filter(vector_to_array(name), lambda v: v != 0)).alias(name) for name in ("word_vector", "char_vector")],
        millionths(F.slice(vector_to_array("features"), -size, size)).alias("structured"),
    )
    return features.meet(features.with_key(fitted, inputs), shown).select("seq", "word_vector", "char_vector", "structured")


def millionths(values):
    return F.array_join(F.transform(values, lambda v: F.round(v * 1_000_000).cast("long").cast("string")), ",")


@query
def m6_w9_votes_and_top_classes(spark, sf):
    """Soft voting and the three most likely classes, on given probabilities of two learners."""
    rows = view(spark, sf, "predictions")

    def given(times, plus):
        raw = [(F.col("seq") * (k + times) + plus * k) % 97 + 1 for k in range(len(P.CATEGORIES))]
        total = sum(raw[1:], raw[0])
        return F.array(*[number / total for number in raw])

    named = rows.select("seq", given(3, 7).alias(f"_p_{models.LOGISTIC}"), given(5, 11).alias(f"_p_{models.FOREST}"))
    voted = models.vote(named, models.ENSEMBLE, list(P.CATEGORIES))
    top = models.top_predictions(voted, list(P.CATEGORIES))
    return top.select(
        "seq", "ml_category", F.round("ml_confidence", 6).alias("ml_confidence"),
        F.array_join("top_predictions.category", " | ").alias("top_classes"), millionths(F.col("top_predictions.probability")).alias("top_probabilities"),
    )


@query
def m3_structured_features(spark, sf):
    inputs = features.feature_inputs(view(spark, sf, "training_rows").select("seq", "procedure", "service_text"))
    return features.structured_features(inputs).select("seq", *features.structured_names())


@query
def m3_structured_features_v1(spark, sf):
    rows = view(spark, sf, "training_rows").select("seq", "procedure", F.lit("").alias("service_text"))
    return features.structured_features(features.feature_inputs(rows), 1).select("seq", *features.structured_names(1))


@query
def m5_m8_scored_rows(spark, sf):
    seen, unseen = seen_and_unseen(spark, sf)
    inputs = models.model_inputs(unseen, "rule_category", keep=["seq"])  # validated on, then scored
    model = models.train_inputs(models.model_inputs(seen, "rule_category", keep=[]), inputs, "rule_category")
    return model.score_inputs(inputs).select(
        "seq", "ml_category", "ml_confidence", F.to_json("top_predictions").alias("top_predictions")
    )


@query
def m11_evaluation(spark, sf):
    seen, unseen = seen_and_unseen(spark, sf)
    model = models.train(seen, unseen, "rule_category")
    return plans.evaluate(model, unseen, label="rule_category").accuracy


@query
def block_routing_of_cases(spark, sf):
    return blocks.route_standalone(parsed(spark, sf)).select("seq", "route")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of the paired exports as a finished case-log row."""
    return paired(spark, sf_dir).case_log()


QUERIES["e2_paired_case_log"] = flagship
