"""Case tables and paired exports to case logs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporlog.functions.staging import written_once
from vaporlog.operators import joins, project, quality
from vaporlog.operators.annotate import annotate, annotate_with_model
from vaporlog.operators.blocks import route_standalone
from vaporlog.operators.models import ProcedureModel
from vaporlog.rules import schema as S
from vaporlog.rules import training as T
from vaporlog.sources import columns, exports, sinks


def case_log_from_table(table: DataFrame, overrides: dict[str, str] | None = None,
                        default_year: int = S.DEFAULT_YEAR, where: str | Column | None = None,
                        model: ProcedureModel | None = None, threshold: float = T.ML_THRESHOLD) -> DataFrame:
    """One case table to its case log: a narrow plan without any shuffle.

    ``where`` is a condition on the table's own columns; it goes to the scan. A ``model`` decides categories
    together with the rules.
    """
    chosen = table if where is None else table.filter(where)
    return project.case_log(_annotated(columns.map_columns(chosen, overrides), default_year, model, threshold))


def _annotated(cases: DataFrame, default_year: int, model: ProcedureModel | None, threshold: float) -> DataFrame:
    return annotate(cases, default_year) if model is None else annotate_with_model(cases, model, threshold, default_year)


@dataclass
class PairedResult:
    """Parsed cases and parsed standalone procedures of paired exports, and the error records of the scan."""

    cases: DataFrame
    standalone: DataFrame
    rejects: DataFrame | None = None
    case_keys: DataFrame | None = None
    standalone_keys: DataFrame | None = None

    def block_log(self) -> DataFrame:
        """Standalone block procedures."""
        return project.standalone_log(self.standalone.filter("route = 'block'"), keep=["pair_key"])

    def neuraxial_log(self) -> DataFrame:
        """Other standalone procedures."""
        return project.standalone_log(self.standalone.filter("route = 'neuraxial'"), keep=["pair_key"])

    def case_log(self) -> DataFrame:
        """The case log of all pairs."""
        return project.case_log(self.cases, keep=["pair_key"])

    def run_summary(self) -> DataFrame:
        """Cases and standalone procedures per resident, counted on their keys: nothing is annotated, no technique is joined."""
        return quality.run_summary(self.case_keys or self.cases, self.standalone_keys or self.standalone)


def parse_pairs(cases: DataFrame, procedures: DataFrame, default_year: int = S.DEFAULT_YEAR,
                seq: str = "_seq", where: str | Column | None = None, model: ProcedureModel | None = None,
                threshold: float = T.ML_THRESHOLD) -> PairedResult:
    """Join, normalize and annotate paired lists: all pairs in one job.

    ``cases`` and ``procedures`` have the export columns plus ``pair_key`` and ``seq``. ``where`` is a condition on
    columns that both have, such as the pair: it goes to the scans of both, below joins and annotation. A ``model``
    decides the categories of cases and of standalone procedures together with the rules.
    """
    if where is not None:
        cases, procedures = cases.filter(where), procedures.filter(where)
    joined = joins.join_techniques(cases, procedures, seq=seq)
    orphans = joins.orphan_procedures(cases, procedures)
    keep = ["pair_key", F.col(seq).alias("seq")]
    return PairedResult(
        _annotated(columns.normalize_cases(joined, keep=keep), default_year, model, threshold),
        route_standalone(_annotated(columns.normalize_orphans(orphans, keep=keep), default_year, model, threshold)),
        case_keys=cases.select("pair_key"),
        standalone_keys=orphans.select("pair_key"),
    )


def build_case_logs(spark: SparkSession, case_dir: str, output: str, procedure_dir: str | None = None,
                    default_year: int = S.DEFAULT_YEAR, force: bool = False, where: str | None = None,
                    mixed_layouts: bool = False, multi_line: bool = True, model: ProcedureModel | None = None,
                    threshold: float = T.ML_THRESHOLD) -> PairedResult:
    """Scan paired exports; write the case log, both standalone logs and the rejected rows.

    Every export is parsed once and kept as columns, which the passes below share. Cases are annotated in the job
    that writes them. Standalone rows are annotated once and kept by route, so each of their logs opens its own
    route's files only. Rows that are no records go to ``rejects`` with their file and text. ``where`` is a
    condition on ``pair_key``: files of other pairs are not opened.
    """
    paired = exports.scan_pairs(spark, case_dir, procedure_dir, mixed_layouts, where, multi_line)
    cases, bad_cases = exports.quarantine(written_once(paired.cases), default_year)
    procedures, bad_procedures = exports.quarantine(written_once(paired.procedures), default_year)
    rejects = bad_cases.withColumn("found_in", F.lit(exports.CASE_SUFFIX)).unionByName(
        bad_procedures.withColumn("found_in", F.lit(exports.PROCEDURE_SUFFIX))
    )
    parsed = parse_pairs(cases, procedures, default_year, model=model, threshold=threshold)
    mode = "overwrite" if force else "errorifexists"
    _write_log(parsed.case_log(), f"{output}/case_log", "caselog", force)
    both = written_once(project.standalone_log(parsed.standalone, keep=["pair_key", "route"]), "route")
    for route, name in (("block", "standalone_blocks"), ("neuraxial", "standalone_neuraxial")):
        _write_log(both.filter(F.col("route") == route).drop("route"), f"{output}/{name}", "standalone", force)
    rejects.write.mode(mode).parquet(f"{output}/rejects")
    return replace(parsed, rejects=spark.read.schema(rejects.schema).parquet(f"{output}/rejects"))


def _write_log(log: DataFrame, path: str, format_type: str, force: bool) -> None:
    named = project.resident_names(log).drop("pair_key", "resident_id")
    sinks.write_with_metadata(named, path, format_type, overwrite=force)
