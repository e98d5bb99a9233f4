"""XML test reports from files and from a column: totals, failures, what can't be read."""

from pyspark.sql import functions as F

from textloom.sources import reports

TRX = """<?xml version="1.0"?>
<TestRun xmlns="http://microsoft.com/schemas/VisualStudio/TeamTest/2010" id="1">
  <Times creation="2024-01-01T00:00:00.0+00:00" start="2024-01-01T00:00:00.000+00:00" finish="{finish}" />
  <Results>
    <UnitTestResult testName="A.ok" outcome="Passed" />
    <UnitTestResult testName="A.bad" outcome="Failed"><Output><ErrorInfo><Message>expected &lt;1&gt;</Message><StackTrace>
      at one
      at two
      at three
      at four</StackTrace></ErrorInfo></Output></UnitTestResult>
    <UnitTestResult outcome="Failed" />
  </Results>
  <ResultSummary outcome="Failed"><Counters total="5" passed="1" failed="2" error="0" /></ResultSummary>
</TestRun>"""
SUREFIRE = """<testsuite name="a.B" tests="4" failures="1" errors="1" skipped="1" time="0.1">
  <properties><property name="x" value="y"/></properties>
  <testcase classname="a.B" name="ok" time="0"/>
  <testcase classname="a.B" name="f"><failure message="no: &quot;x&quot;
next" type="E">stack</failure></testcase>
  <testcase classname="a.B" name="e"><error type="E">first line
second</error></testcase>
  <testcase classname="a.B" name="s"><skipped/></testcase>
</testsuite>"""


def test_trx_column(spark):
    texts = [TRX.format(finish="2024-01-01T00:00:02.345+00:00"), TRX.format(finish="2024-01-01T00:00:00.250+00:00"), "<TestRun><Results></TestRun>", "no xml", "", None, "<TestRun/>"]
    rows = reports.parse_reports(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "trx")
    got = {r.doc_id: r for r in rows.withColumn("t", reports.trx_tests(F.col("report"))).collect()}
    assert [bool(got[i].report) for i in range(7)] == [True, True, False, False, False, False, True]
    assert got[2]._corrupt == texts[2] and got[3]._corrupt == "no xml" and got[0]._corrupt is None
    t = got[0].t
    assert (t.total, t.passed, t.failed, t.skipped, t.duration, got[1].t.duration) == (5, 1, 2, 2, "2.3 s", "250 ms")
    assert [(f.name, f.details) for f in t.failed_tests] == [("A.bad", ["expected <1>", "at one\n      at two\n      at three"]), ("unknown", [])]
    assert (got[6].t.total, got[6].t.duration, got[6].t.failed_tests) == (0, None, [])


def test_files(spark, tmp_path):
    (tmp_path / "m" / "n").mkdir(parents=True)
    (tmp_path / "m" / "n" / "TEST-a.xml").write_text(SUREFIRE)
    (tmp_path / "TEST-b.xml").write_text(SUREFIRE.replace("a.B", "c.D"))
    (tmp_path / "TEST-broken.xml").write_text("<testsuite tests='1'><testcase></testsuite>")
    rows = reports.read_reports(spark, str(tmp_path), "surefire").cache()
    assert rows.count() == 3 and rows.filter("report IS NULL AND _corrupt IS NOT NULL").count() == 1
    one = reports.surefire_summary(rows.withColumn("build", F.lit(1)), "build", "file").first().summary
    block = "FAIL: {0}.f — no: \"x\" next\nERR: {0}.e — first line\n"
    assert one == "TESTS: 8 OK=2 FAIL=2 ERR=2 SKIP=2\n" + block.format("c.D") + block.format("a.B") or one == "TESTS: 8 OK=2 FAIL=2 ERR=2 SKIP=2\n" + block.format("a.B") + block.format("c.D")
