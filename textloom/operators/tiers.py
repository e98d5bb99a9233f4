"""Three-tier parsers: a result from JSON (full), else from patterns (degraded, with warnings), else the text itself (raw).

A parser is one expression; all tiers give the same struct, so a column of mixed outputs has one type:
struct(tier, result, warnings, raw). Results are of two kinds, tests and dependencies, with formats of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as X

#: Characters of a raw text that are shown, failures and packages listed.
RAW_CHARS, FAILURES, UPGRADES, PACKAGES = 2000, 5, 10, 50
#: How deep suites and packages may lie in each other; what is deeper is not read.
NESTED = 6

FAILURE = "struct<name:string,file:string,error:string>"
TESTS = f"struct<total:bigint,passed:bigint,failed:bigint,skipped:bigint,duration_ms:bigint,failures:array<{FAILURE}>>"
PACKAGE = "struct<name:string,current:string,latest:string,wanted:string,dev:boolean>"
PACKAGES_OF = f"struct<total:bigint,outdated:bigint,packages:array<{PACKAGE}>>"
JSON_FAILED = "JSON parse failed"


def _tiers(text: Column, full: Column, found: Column, degraded: Column, kind: str) -> Column:
    """The struct of the first tier that fits: full where found, degraded where it is not null, else raw."""
    made = lambda tier, result, warnings, raw: F.struct(F.lit(tier).alias("tier"), result.cast(kind).alias("result"), warnings.alias("warnings"), raw.cast("string").alias("raw"))
    none = F.array().cast("array<string>")
    raw = F.when(F.length(text) > RAW_CHARS, F.concat(F.left(text, F.lit(RAW_CHARS)), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(found, F.lit(False)), made("full", full, none, F.lit(None))).when(degraded.isNotNull(), made("degraded", degraded, F.array(F.lit(JSON_FAILED)), F.lit(None))).otherwise(made("raw", F.lit(None), none, F.coalesce(raw, F.lit(""))))


def _count(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("bigint"), F.lit(0).cast("bigint"))


def _tests(passed: Column, failed: Column, skipped: Column, duration: Column, failures: Column, total: Column | None = None) -> Column:
    whole = passed + failed + skipped if total is None else total
    return F.struct(whole.alias("total"), passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), duration.cast("bigint").alias("duration_ms"), failures.cast(f"array<{FAILURE}>").alias("failures")).cast(TESTS)


def _failure(name: Column, file: Column, error: Column) -> Column:
    return F.struct(name.alias("name"), file.alias("file"), error.alias("error"))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)


def _millis(text: Column, pattern: str, units: dict[str, int]) -> Column:
    value, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    return F.floor(value * X.lookup(unit, units)).cast("bigint")


VITEST = "struct<testResults:array<struct<name:string,assertionResults:array<struct<fullName:string,status:string,failureMessages:array<string>>>>>,numTotalTests:bigint,numPassedTests:bigint,numFailedTests:bigint,numPendingTests:bigint>"


def vitest(text: Column) -> Column:
    """Tests of a JSON report, also after other output; else of the lines Tests and Duration."""
    before = F.substring_index(text, '"numTotalTests"', 1)
    marked = F.when(text.contains('"numTotalTests"') & before.contains("{"), F.substr(text, F.length(F.regexp_replace(before, r"(?s)\{[^{]*\z", "")) + 1))
    own_line = F.regexp_extract(text, r"(?s)(?:\A|\n)[ \t]*(\{.*)", 1)
    read = lambda x: F.from_json(x, VITEST)
    good = lambda j: j["numTotalTests"].isNotNull() & j["numPassedTests"].isNotNull() & j["numFailedTests"].isNotNull() & j["testResults"].isNotNull()
    whole, later = read(text), read(F.coalesce(marked, own_line))
    json = F.when(good(whole), whole).when(good(later), later)
    failed = lambda file: F.transform(F.filter(file["assertionResults"], lambda t: t["status"] == "failed"), lambda t: _failure(t["fullName"], file["name"], F.array_join(t["failureMessages"], "\n")))
    zero = F.lit(0).cast("bigint")
    full = _tests(json["numPassedTests"], json["numFailedTests"], F.coalesce(json["numPendingTests"], zero), F.lit(None), F.flatten(F.transform(json["testResults"], failed)), json["numTotalTests"])
    clean = X.strip_ansi(text)
    pattern = r"Tests\s+(?:(\d+)\s+failed\s+\|\s+)?(\d+)\s+passed"
    bad, good_ones = _count(clean, pattern, 1), _count(clean, pattern, 2)
    kind = f"struct<open:boolean,out:array<struct<name:string,lines:array<string>>>>"
    last = lambda a: F.element_at(a["out"], -1)

    def step(a: Column, line: Column) -> Column:
        more = F.struct(F.lit(True).alias("open"), F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(last(a)["name"].alias("name"), F.concat(last(a)["lines"], F.array(X.trim(line))).alias("lines")))).alias("out"))
        fresh = F.struct(F.lit(True).alias("open"), F.concat(a["out"], F.array(F.struct(line.alias("name"), F.array().cast("array<string>").alias("lines")))).alias("out"))
        return F.when(a["open"] & line.startswith("  "), more.cast(kind)).when(line.contains("[x]") | line.contains("FAIL"), fresh.cast(kind)).otherwise(F.struct(F.lit(False).alias("open"), a["out"].alias("out")).cast(kind))

    start = F.struct(F.lit(False).alias("open"), F.array().alias("out")).cast(kind)
    failures = F.transform(F.aggregate(_lines(clean), start, step)["out"], lambda f: _failure(f["name"], F.lit(""), F.array_join(f["lines"], "\n")))
    degraded = F.when(bad + good_ones > 0, _tests(good_ones, bad, zero, _millis(clean, r"Duration\s+([\d.]+)(ms|s)", {"ms": 1, "s": 1000}), failures))
    return _tiers(text, full, json.isNotNull(), degraded, TESTS)


_SPEC = "array<struct<title:string,ok:boolean,tests:array<struct<status:string,results:array<struct<status:string,errors:array<struct<message:string>>>>>>>>"


def _suite(depth: int) -> str:
    return f"array<struct<title:string,file:string,specs:{_SPEC}{f',suites:{_suite(depth - 1)}' if depth else ''}>>"


def playwright(text: Column) -> Column:
    """Specs of a JSON report in the order of their suites; else the counts of the summary and failed specs."""
    json = F.from_json(text, f"struct<stats:struct<expected:bigint,unexpected:bigint,skipped:bigint,duration:double>,suites:{_suite(NESTED)}>")

    def specs(suites: Column, depth: int) -> Column:
        def of(suite: Column) -> Column:
            file = F.coalesce(suite["file"], suite["title"])
            own = F.transform(F.coalesce(suite["specs"], F.array().cast(_SPEC)), lambda s: F.struct(s["title"].alias("title"), file.alias("file"), s["ok"].alias("ok"), _first_error(s).alias("error")))
            return F.concat(own, specs(suite["suites"], depth - 1)) if depth else own

        return F.flatten(F.transform(F.coalesce(suites, F.array().cast(_suite(depth))), of))

    found = specs(json["suites"], NESTED)
    failures = F.transform(F.filter(found, lambda s: ~s["ok"]), lambda s: _failure(s["title"], s["file"], s["error"]))
    stats = json["stats"]
    full = _tests(stats["expected"], stats["unexpected"], stats["skipped"], F.floor(F.coalesce(stats["duration"], F.lit(0.0))), failures, F.size(found).cast("bigint"))
    clean = X.strip_ansi(text)
    last = lambda word: F.coalesce(F.try_element_at(F.regexp_extract_all(clean, F.lit(rf"(\d+)\s+{word}"), 1), F.lit(-1)).try_cast("bigint"), F.lit(0).cast("bigint"))
    passed, failed, skipped = last("passed"), last("failed"), last("skipped")
    named = r"[×✗]\s+.*?›\s+([^›]+\.spec\.[tj]sx?)"
    listed = F.transform(F.arrays_zip(F.regexp_extract_all(clean, F.lit(f"({named})"), 1).alias("a"), F.regexp_extract_all(clean, F.lit(named), 1).alias("b")), lambda x: _failure(x["a"], x["b"], F.lit("")))
    degraded = F.when(passed + failed + skipped > 0, _tests(passed, failed, skipped, _millis(clean, r"\((\d+(?:\.\d+)?)(ms|s|m)\)", {"ms": 1, "s": 1000, "m": 60_000}), listed))
    return _tiers(text, full, stats["expected"].isNotNull() & stats["unexpected"].isNotNull() & stats["skipped"].isNotNull(), degraded, TESTS)


def _first_error(spec: Column) -> Column:
    """The message of the first failed run of the first unexpected test."""
    test = F.get(F.filter(spec["tests"], lambda t: t["status"] == "unexpected"), F.lit(0))
    run = F.get(F.filter(test["results"], lambda r: r["status"].isin("failed", "timedOut")), F.lit(0))
    error = F.get(run["errors"], F.lit(0))
    return F.when(error.isNotNull(), F.coalesce(error["message"], F.lit(""))).otherwise("Test failed")


def _package(name: Column, current: Column, latest: Column, wanted: Column, dev: Column) -> Column:
    return F.struct(name.alias("name"), current.alias("current"), latest.cast("string").alias("latest"), wanted.cast("string").alias("wanted"), dev.alias("dev")).cast(PACKAGE)


def _state(packages: Column, outdated: Column) -> Column:
    return F.struct(F.size(packages).cast("bigint").alias("total"), outdated.cast("bigint").alias("outdated"), packages.alias("packages")).cast(PACKAGES_OF)


def _listed(depth: int) -> str:
    return f"map<string,struct<version:string{f',dependencies:{_listed(depth - 1)},devDependencies:{_listed(depth - 1)}' if depth else ''}>>"


def pnpm_list(text: Column) -> Column:
    """Packages of a JSON listing with all that they depend on, by name at each level; else of lines name@version."""
    root = f"array<struct<name:string,version:string,dependencies:{_listed(NESTED)},devDependencies:{_listed(NESTED)}>>"
    json = F.from_json(text, root)
    none = F.array().cast(f"array<{PACKAGE}>")

    def own(name: Column, item: Column, dev: Column) -> Column:
        return F.when(item["version"].isNotNull(), F.array(_package(name, item["version"], F.lit(None), F.lit(None), dev))).otherwise(none)

    def below(items: Column, dev: Column, depth: int) -> Column:
        entries = F.array_sort(F.map_entries(items), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.coalesce(F.flatten(F.transform(entries, lambda e: whole(e["key"], e["value"], dev, depth))), none)

    def whole(name: Column, item: Column, dev: Column, depth: int) -> Column:
        parts = [own(name, item, dev)]
        if depth:
            parts += [below(item["dependencies"], dev, depth - 1), below(item["devDependencies"], F.lit(True), depth - 1)]
        return F.concat(*parts)

    full = F.flatten(F.transform(json, lambda p: F.concat(own(p["name"], p, F.lit(False)), below(p["dependencies"], F.lit(False), NESTED), below(p["devDependencies"], F.lit(True), NESTED))))
    kind = f"struct<dev:boolean,out:array<{PACKAGE}>>"

    def step(a: Column, line: Column) -> Column:
        t = X.trim(line)
        word = F.get(F.split(t, r"\s+"), F.lit(0))
        name, version = F.regexp_extract(word, "^(.+)@([^@]+)$", 1), F.regexp_extract(word, "^(.+)@([^@]+)$", 2)
        skipped = line.rlike("[│├└]|Legend:") | (name == "")
        dev = F.when(t == "devDependencies:", True).when(t == "dependencies:", False).otherwise(a["dev"])
        more = F.when(skipped, a["out"]).otherwise(F.concat(a["out"], F.array(_package(name, version, F.lit(None), F.lit(None), a["dev"]))))
        return F.struct(dev.alias("dev"), more.alias("out")).cast(kind)

    found = F.aggregate(_lines(text), F.struct(F.lit(False).alias("dev"), none.alias("out")).cast(kind), step)["out"]
    named = F.forall(json, lambda p: p["name"].isNotNull())
    return _tiers(text, _state(full, F.lit(0)), X.trim(text).startswith("[") & named, F.when(F.size(found) > 0, _state(found, F.lit(0))), PACKAGES_OF)


def pnpm_outdated(text: Column) -> Column:
    """Packages of a JSON object by name, sorted; else of lines with name, current, wanted and latest version."""
    json = F.from_json(text, "map<string,struct<current:string,latest:string,wanted:string,dependencyType:string>>")
    entries = F.array_sort(F.map_entries(json), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    full = F.transform(entries, lambda e: _package(e["key"], e["value"]["current"], e["value"]["latest"], e["value"]["wanted"], F.coalesce(e["value"]["dependencyType"] == "devDependencies", F.lit(False))))
    found = F.forall(F.map_values(json), lambda v: v["current"].isNotNull() & v["latest"].isNotNull())
    rows = F.filter(_lines(text), lambda x: ~x.rlike("[│├└─]|^Legend:|^Package") & (X.trim(x) != ""))
    parts = F.filter(F.transform(rows, lambda x: F.split(X.trim(x), r"\s+")), lambda p: F.size(p) >= 4)
    listed = F.transform(parts, lambda p: _package(p[0], p[1], p[3], p[2], F.lit(False)))
    late = lambda ps: F.size(F.filter(ps, lambda p: p["current"] != p["latest"]))
    return _tiers(text, _state(full, late(full)), X.trim(text).startswith("{") & found, F.when(F.size(listed) > 0, _state(listed, late(listed))), PACKAGES_OF)


def format_tests(parsed: Column) -> Column:
    """The compact form of a parsed test run; of a raw one its text."""
    r = parsed["result"]
    text = lambda c: c.cast("string")
    head = F.concat(F.lit("PASS ("), text(r["passed"]), F.lit(") FAIL ("), text(r["failed"]), F.lit(")"), F.when(r["skipped"] > 0, F.concat(F.lit(" skipped ("), text(r["skipped"]), F.lit(")"))).otherwise(""))
    error = lambda f: F.when(f["error"] == "", "").otherwise(F.concat(F.lit("\n"), F.array_join(F.transform(_lines(f["error"]), lambda x: F.concat(F.lit("   "), x)), "\n")))
    each = F.transform(F.slice(r["failures"], 1, FAILURES), lambda f, i: F.concat(text(i + 1), F.lit(". "), f["name"], error(f)))
    more = F.size(r["failures"]) - FAILURES
    failures = F.when(F.size(r["failures"]) > 0, F.concat(F.lit("\n\n"), F.array_join(each, "\n"), F.when(more > 0, F.concat(F.lit("\n\n... +"), text(more), F.lit(" more failures"))).otherwise(""))).otherwise("")
    time = F.coalesce(F.concat(F.lit("\n\nTime: "), text(r["duration_ms"]), F.lit("ms")), F.lit(""))
    return F.coalesce(F.concat(head, failures, time), parsed["raw"])


def format_packages(parsed: Column) -> Column:
    """The compact form of parsed packages: a listing, or what is outdated; of a raw one its text."""
    r = parsed["result"]
    text = lambda c: c.cast("string")
    packages = r["packages"]
    listing = (r["outdated"] == 0) & (F.size(packages) > 0) & F.forall(packages, lambda p: p["latest"].isNull())
    rows = F.transform(F.slice(packages, 1, PACKAGES), lambda p: F.concat(F.lit("\n  "), p["name"], F.lit(" "), p["current"], F.when(p["dev"], " (dev)").otherwise("")))
    more = F.size(packages) - PACKAGES
    shown = F.concat(text(r["total"]), F.lit(" packages"), F.array_join(rows, ""), F.when(more > 0, F.concat(F.lit("\n  ... +"), text(more), F.lit(" more"))).otherwise(""))
    late = F.filter(F.slice(packages, 1, UPGRADES), lambda p: p["latest"].isNotNull() & (p["current"] != p["latest"]))
    more = r["outdated"] - UPGRADES
    old = F.concat(text(r["outdated"]), F.lit(" outdated packages (of "), text(r["total"]), F.lit(")"), F.array_join(F.transform(late, lambda p: F.concat(F.lit("\n"), p["name"], F.lit(": "), p["current"], F.lit(" → "), p["latest"])), ""), F.when(more > 0, F.concat(F.lit("\n\n... +"), text(more), F.lit(" more"))).otherwise(""))
    return F.when(listing, shown).when(r["outdated"] == 0, "All packages up-to-date").otherwise(F.coalesce(old, parsed["raw"]))
