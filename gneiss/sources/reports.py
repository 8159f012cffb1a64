"""Reports of runs: their names, writing them without ever overwriting one, and reading them back as tables.

A report holds aggregates, so it is small and written by the driver; reading a folder of them is distributed.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of reports of trials, of paid runs, and of paid runs with the second layer.
TRIAL, PAID, PAID_JUDGED = "evaluation", "evaluation-live", "evaluation-live-l2"
_CASES = "array<struct<case_id:string,matched:boolean>>"
_ATTRIBUTED = "array<struct<case_id:string,relevant_evidence_ids:array<string>,missing_relevant_evidence_ids:array<string>>>"
REPORT = (
    "conditions struct<started_at:string,billed:boolean,measurement2_is_real:boolean,l2_enabled:boolean,generation:string,embedding:string,judge:string,retrieval_strategy:string,condition_fingerprint:map<string,string>>,"
    " measurement_1_l1_gate_accuracy struct<detection_rate:double,false_positive_rate:double>,"
    f" measurement_2_pipeline_agreement struct<match_rate:double,outcomes:{_CASES}>, failure_attribution struct<computed:boolean,reason:string,cases:{_ATTRIBUTED}>"
)


def _taken(folder: str) -> set[str]:
    return {p.stem.casefold() for p in Path(folder).glob("*.*")} if Path(folder).is_dir() else set()


def next_free(folder: str, stem: str) -> str:
    """``stem``-1, -2 and so on: the first that no report has."""
    taken, n = _taken(folder), 1
    while f"{stem}-{n}".casefold() in taken:
        n += 1
    return f"{stem}-{n}"


def report_name(folder: str, paid: bool, judged: bool, requested: str | None = None) -> str:
    """The name of a run's report; ValueError where the name requested doesn't fit the run.

    Paid runs, and only they, have a paid name; of them those with the second layer, and only they, a name of the
    judged series. A paid report isn't overwritten. Names are parts of file names, whatever their case.
    """
    name = requested if requested is not None else TRIAL if not paid else next_free(folder, PAID_JUDGED) if judged else PAID
    if not name or name != name.strip() or name.startswith(".") or "/" in name or "\\" in name:
        raise ValueError(f"not a part of a file name: {name!r}")
    folded = name.casefold()
    if folded.startswith(PAID) != paid:
        raise ValueError(f"{name!r} is {'no' if paid else 'a'} name of a paid run")
    if paid and folded.startswith(PAID_JUDGED) != judged:
        raise ValueError(f"{name!r} is of the series {'without' if judged else 'with'} the second layer")
    if paid and folded in _taken(folder):
        raise ValueError(f"{name!r} is taken; free is {next_free(folder, PAID_JUDGED if judged else PAID)!r}")
    return name


def write_report(folder: str, name: str, title: str, tables: dict[str, DataFrame]) -> list[str]:
    """Write aggregates as Markdown and JSON; an existing file is an error, and nothing is then left half written.

    Each table's rows are sorted by their columns, so a report is the same however it was computed.
    """
    rows = {n: sorted((r.asDict(True) for r in t.collect()), key=lambda r: [str(v) for v in r.values()]) for n, t in tables.items()}
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}"]
    for n, t in tables.items():
        lines += ["", f"## {n}", "", "| " + " | ".join(t.columns) + " |", "|" + "---|" * len(t.columns), *("| " + " | ".join(cell(r[c]) for c in t.columns) + " |" for r in rows[n])]
    Path(folder).mkdir(parents=True, exist_ok=True)
    files = {Path(folder) / f"{name}.md": "\n".join(lines) + "\n", Path(folder) / f"{name}.json": json.dumps({"title": title, **rows}, ensure_ascii=False, sort_keys=True, default=str)}
    if there := [str(p) for p in files if p.exists()]:
        raise FileExistsError(", ".join(there))
    for path, text in files.items():
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
    return [str(p) for p in files]


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, started_at, paid, judged, detection_rate, false_positive_rate, match_rate, attributed, conditions, cases,
    attributed_cases): a row per report. What an older report lacks is null; run_id is the file's name."""
    r = spark.read.schema(REPORT).option("multiLine", "true").option("mode", "FAILFAST").json(path, pathGlobFilter="*.json")
    run = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    c = F.col("conditions")
    return r.select(
        run.alias("run_id"), c["started_at"].alias("started_at"), F.coalesce(c["billed"], c["measurement2_is_real"], F.lit(False)).alias("paid"), F.coalesce(c["l2_enabled"], F.lit(False)).alias("judged"),
        F.col("measurement_1_l1_gate_accuracy.detection_rate"), F.col("measurement_1_l1_gate_accuracy.false_positive_rate"), F.col("measurement_2_pipeline_agreement.match_rate"), F.coalesce("failure_attribution.computed", F.lit(False)).alias("attributed"),
        F.struct(c["generation"].alias("generation"), c["embedding"].alias("embedding"), c["judge"].alias("judge"), c["retrieval_strategy"].alias("strategy"), c["condition_fingerprint"].alias("explicit")).alias("conditions"),
        F.col("measurement_2_pipeline_agreement.outcomes").alias("cases"), F.when(F.col("failure_attribution.computed"), F.col("failure_attribution.cases")).alias("attributed_cases"),
    )


def run_cases(reports: DataFrame) -> DataFrame:
    """(case_id, run_id, passed): the cases of every run."""
    return reports.select("run_id", F.inline("cases")).filter("case_id is not null").select("case_id", "run_id", F.coalesce("matched", F.lit(False)).alias("passed"))


def run_evidence(reports: DataFrame) -> DataFrame:
    """(case_id, run_id, evidence_id, accepted): relevant evidence that runs report, as ``evidence_lost`` reads it."""
    rows = reports.select("run_id", F.inline("attributed_cases"))
    return rows.filter(F.col("missing_relevant_evidence_ids").isNotNull()).select("case_id", "run_id", F.explode("relevant_evidence_ids").alias("evidence_id"), "missing_relevant_evidence_ids").select("case_id", "run_id", "evidence_id", (~F.array_contains("missing_relevant_evidence_ids", F.col("evidence_id"))).alias("accepted"))
