"""XML reports of test runs: TRX (a TestRun) and Surefire (a testsuite), read from files by Spark's XML reader or from a column of texts.

Schemas are explicit, so nothing is inferred from a sample; elements and attributes beside them are ignored, namespaces too.
A file or text that can't be read keeps its text in _corrupt and counts as no report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X

_ERROR = "struct<ErrorInfo:struct<Message:string,StackTrace:string>>"
TRX = f"Times struct<_start:string,_finish:string>, Results struct<UnitTestResult:array<struct<_testName:string,_outcome:string,Output:{_ERROR}>>>, ResultSummary struct<Counters:struct<_total:bigint,_passed:bigint,_failed:bigint>>"
_CAUSE = "array<struct<_VALUE:string,_message:string>>"
SUREFIRE = f"_tests bigint, _failures bigint, _errors bigint, _skipped bigint, testcase array<struct<_classname:string,_name:string,failure:{_CAUSE},error:{_CAUSE}>>"
#: The element of each kind of report that is one report, and its schema.
KINDS = {"trx": ("TestRun", TRX), "surefire": ("testsuite", SUREFIRE)}
CORRUPT = "_corrupt"


def read_reports(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, report) of all XML files below path; a row a report, with report null and _corrupt set where it can't be read."""
    tag, schema = KINDS[kind]
    options = {"rowTag": tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
    rows = spark.read.format("xml").options(**options).option("recursiveFileLookup", "true").schema(f"{schema}, {CORRUPT} string").load(path)
    names = [f.name for f in rows.schema if f.name != CORRUPT]
    return rows.select(F.col("_metadata.file_path").alias("file"), F.when(F.col(CORRUPT).isNull(), F.struct(*names)).alias("report"), CORRUPT)


def parse_reports(docs: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """docs with report, and _corrupt with the text where it is no report of the kind."""
    tag, schema = KINDS[kind]
    names = [f.split(" ")[0] for f in ("Times", "Results", "ResultSummary")] if kind == "trx" else ["_tests", "_failures", "_errors", "_skipped", "testcase"]
    text = F.when(F.col(text_col).rlike(rf"<(\w+:)?{tag}[\s>/]"), F.col(text_col))
    options = {"rowTag": tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
    read = docs.withColumn("_x", F.from_xml(text, f"{schema}, {CORRUPT} string", options))
    good = F.col("_x").isNotNull() & F.col(f"_x.{CORRUPT}").isNull()
    report = F.when(good, F.struct(*[F.col(f"_x.{n}").alias(n) for n in names]))
    return read.withColumns({"report": report, CORRUPT: F.when(~good, F.col(text_col))}).drop("_x")


def _zero(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0).cast("bigint")), F.lit(0))


def trx_tests(report: Column) -> Column:
    """struct(total, passed, failed, skipped, duration, failed_tests(name, details)) of a TRX report."""
    counters = report["ResultSummary"]["Counters"]
    total, passed, failed = _zero(counters["_total"]), _zero(counters["_passed"]), _zero(counters["_failed"])
    at = lambda name: F.unix_millis(F.try_to_timestamp(report["Times"][name]))
    millis = at("_finish") - at("_start")
    duration = F.when(millis >= 1000, F.format_string("%.1f s", millis / 1000.0)).when(millis > 0, F.concat(millis.cast("string"), F.lit(" ms")))
    results = F.coalesce(report["Results"]["UnitTestResult"], F.array().cast("array<struct<_testName:string,_outcome:string,Output:struct<ErrorInfo:struct<Message:string,StackTrace:string>>>>"))

    def details(r: Column) -> Column:
        info = r["Output"]["ErrorInfo"]
        message, stack = X.trim(F.coalesce(info["Message"], F.lit(""))), X.trim(F.coalesce(info["StackTrace"], F.lit("")))
        first = F.array_join(F.slice(F.split(stack, r"\r?\n"), 1, 3), "\n")
        return F.filter(F.array(message, first), lambda x: x != "")

    failures = F.transform(F.filter(results, lambda r: r["_outcome"] == "Failed"), lambda r: F.struct(F.coalesce(r["_testName"], F.lit("unknown")).alias("name"), details(r).alias("details")))
    return F.struct(total.alias("total"), passed.alias("passed"), failed.alias("failed"), F.greatest(total - passed - failed, F.lit(0)).alias("skipped"), duration.alias("duration"), failures.alias("failed_tests"))


def surefire_tests(report: Column) -> Column:
    """struct(tests, failures, errors, skipped, cases(kind, class, name, message)) of a Surefire report."""

    def message(causes: Column) -> Column:
        cause = F.element_at(causes, -1)
        text = F.coalesce(cause["_message"], X.trim(F.get(F.split(X.trim(F.coalesce(cause["_VALUE"], F.lit(""))), r"\r?\n"), F.lit(0))))
        clean = F.translate(text, "\n", " ")
        return F.when(F.length(clean) <= 80, clean).otherwise(F.concat(F.left(clean, F.lit(80)), F.lit("…")))

    some = lambda causes: F.coalesce(F.size(causes) > 0, F.lit(False))
    cases = F.coalesce(report["testcase"], F.array().cast(f"array<struct<_classname:string,_name:string,failure:{_CAUSE},error:{_CAUSE}>>"))
    bad = F.filter(cases, lambda c: some(c["failure"]) | some(c["error"]))
    made = F.transform(bad, lambda c: F.struct(F.when(some(c["error"]), "ERR").otherwise("FAIL").alias("kind"), F.coalesce(c["_classname"], F.lit("")).alias("class"), F.coalesce(c["_name"], F.lit("")).alias("name"), F.when(some(c["error"]), message(c["error"])).otherwise(message(c["failure"])).alias("message")))
    return F.struct(_zero(report["_tests"]).alias("tests"), _zero(report["_failures"]).alias("failures"), _zero(report["_errors"]).alias("errors"), _zero(report["_skipped"]).alias("skipped"), made.alias("cases"))


def trx_totals(reports: DataFrame, by: list[str]) -> DataFrame:
    """Totals of the TRX reports of each group: reports, total, passed, failed, skipped."""
    rows = reports.filter("report IS NOT NULL").withColumn("t", trx_tests(F.col("report")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("reports"), *[F.sum(f"t.{c}").alias(c) for c in ("total", "passed", "failed", "skipped")])


def surefire_summary(reports: DataFrame, by: str, order: str) -> DataFrame:
    """(by, summary): the added totals of a group's Surefire reports, and its failed cases in the order of the reports."""
    rows = reports.filter("report IS NOT NULL").withColumn("t", surefire_tests(F.col("report")))
    line = lambda c: F.concat(c["kind"], F.lit(": "), c["class"], F.lit("."), c["name"], F.lit(" — "), c["message"], F.lit("\n"))
    rows = rows.select(by, order, "t.*", F.array_join(F.transform("t.cases", line), "").alias("shown"))
    sums = rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tests", "failures", "errors", "skipped")], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "shown"))), lambda x: x["shown"]), "").alias("shown"))
    text = lambda c: c.cast("string")
    ok = F.greatest(F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped"), F.lit(0))
    return sums.select(by, F.concat(F.lit("TESTS: "), text(F.col("tests")), F.lit(" OK="), text(ok), F.lit(" FAIL="), text(F.col("failures")), F.lit(" ERR="), text(F.col("errors")), F.lit(" SKIP="), text(F.col("skipped")), F.lit("\n"), "shown").alias("summary"))
