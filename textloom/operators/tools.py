"""Outputs of single tools, expressed as specifications of six shapes.

diagnostics: lines that name a file, place, severity and code, grouped and counted.
counters: totals of passed, failed, skipped and so on, read from summary lines.
columns: rows of fixed-width or tab-separated tables.
records: JSON lists flattened to one line of chosen fields an item.
sections: blocks of lines from a start line on (runs.blocks).
noise: lines to leave out (dsl.Filter).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators import runs
from textloom.operators.dsl import Filter

# name: (pattern, group of file, line, severity, code, message); 0 where a form has no such group
DIAGNOSTICS = {
    "tsc": (r"^(.+?)[(:](\d+)[,:]\d+\)?(?: -|:) (error|warning) (TS\d+): (.+)$", 1, 2, 3, 4, 5),
    "mypy": (r"^(.+?):(\d+):(?:\d+:)? (error|warning|note): (.+?)(?:\s+\[([\w-]+)\])?$", 1, 2, 3, 5, 4),
    "ruff": (r"^(.+?):(\d+):\d+: ([A-Z]+\d+) (?:\[\*\] )?(.+)$", 1, 2, 0, 3, 4),
    "pylint": (r"^(.+?):(\d+):\d+: ([CRWEF])\d+: (.+) \(([\w-]+)\)$", 1, 2, 3, 5, 4),
    "eslint": (r"^(.+?):(\d+):\d+: (.+) \[(Error|Warning)/([\w/@-]+)\]$", 1, 2, 4, 5, 3),
    "rubocop": (r"^(.+?):(\d+):\d+: ([CWEF]): (?:\[Correctable\] )?([\w/]+): (.+)$", 1, 2, 3, 4, 5),
    "golangci": (r"^(.+?):(\d+):(?:\d+:)? (.+) \((\w+)\)$", 1, 2, 0, 4, 3),
    "go": (r"^(.+?\.go):(\d+):(?:\d+:)? (.+)$", 1, 2, 0, 0, 3),
    "gcc": (r"^(.+?):(\d+):\d+: (fatal error|error|warning|note): (.+?)(?: \[(-W[\w=-]+)\])?$", 1, 2, 3, 5, 4),
    "dotnet": (r"^(.+?)\((\d+),\d+\): (error|warning) ([A-Z]+\d+): (.+?)(?: \[.+\])?$", 1, 2, 3, 4, 5),
    "phpstan": (r"^(.+?):(\d+):(.+)$", 1, 2, 0, 0, 3),
    "maven": (r"^\[(ERROR|WARNING)\] (.+?):\[(\d+),\d+\] (.+)$", 2, 3, 1, 0, 4),
    "sbt": (r"^\[(error|warn)\] (.+?):(\d+)(?::\d+)?: (.+)$", 2, 3, 1, 0, 4),
    "kotlin": (r"^([ew]): (?:file://)?(.+?):(\d+):\d+ (.+)$", 2, 3, 1, 0, 4),
    "shellcheck": (r"^(.+?):(\d+):\d+: (error|warning|note|style): (.+) \[(SC\d+)\]$", 1, 2, 3, 5, 4),
    "yamllint": (r"^(.+?):(\d+):\d+: \[(error|warning)\] (.+) \(([\w-]+)\)$", 1, 2, 3, 5, 4),
    "hadolint": (r"^(.+?):(\d+) (DL\d+|SC\d+) (error|warning|info|style): (.+)$", 1, 2, 4, 3, 5),
    "markdownlint": (r"^(.+?):(\d+)(?::\d+)? (MD\d+)(?:/[\w-]+)* (.+)$", 1, 2, 0, 3, 4),
    "php_lint": (r"^(?:PHP )?(Parse error|Fatal error): (.+) in (.+?) on line (\d+)$", 3, 4, 1, 0, 2),
    "basedpyright": (r"^\s*(.+?):(\d+):\d+ - (error|warning): (.+?)(?: \((\w+)\))?$", 1, 2, 3, 5, 4),
    "xcodebuild": (r"^(.+?):(\d+):\d+: (error|warning): (.+)$", 1, 2, 3, 0, 4),
    "grep": (r"^(.+?):(\d+):(.*)$", 1, 2, 0, 0, 3),
}

# name: counter, pattern whose first group is its number
COUNTERS = {
    "cargo_test": {"passed": r"test result: \w+\. (\d+) passed", "failed": r"(\d+) failed;", "ignored": r"(\d+) ignored"},
    "pytest": {"passed": r"(\d+) passed", "failed": r"(\d+) failed", "skipped": r"(\d+) skipped", "xfailed": r"(\d+) xfailed", "xpassed": r"(\d+) xpassed", "errors": r"(\d+) errors?\b"},
    "jest": {"passed": r"Tests:.*?(\d+) passed", "failed": r"Tests:.*?(\d+) failed", "total": r"Tests:.*?(\d+) total"},
    "vitest": {"passed": r"Tests\s.*?(\d+) passed", "failed": r"Tests\s.*?(\d+) failed"},
    "playwright": {"passed": r"(\d+) passed", "failed": r"(\d+) failed", "flaky": r"(\d+) flaky", "skipped": r"(\d+) skipped"},
    "rspec": {"examples": r"(\d+) examples?", "failures": r"(\d+) failures?", "pending": r"(\d+) pending"},
    "minitest": {"runs": r"(\d+) runs", "assertions": r"(\d+) assertions", "failures": r"(\d+) failures", "errors": r"(\d+) errors", "skips": r"(\d+) skips"},
    "phpunit": {"tests": r"Tests: (\d+)|OK \((\d+) tests?", "assertions": r"Assertions: (\d+)", "failures": r"Failures: (\d+)", "errors": r"Errors: (\d+)", "skipped": r"Skipped: (\d+)"},
    "dotnet_test": {"passed": r"Passed:\s+(\d+)", "failed": r"Failed:\s+(\d+)", "skipped": r"Skipped:\s+(\d+)", "total": r"Total:\s+(\d+)"},
    "maven": {"tests": r"Tests run: (\d+)", "failures": r"Failures: (\d+)", "errors": r"Errors: (\d+)", "skipped": r"Skipped: (\d+)"},
    "gradle": {"tests": r"(\d+) tests completed", "failed": r"(\d+) failed"},
    "sbt": {"succeeded": r"succeeded (\d+)", "failed": r"failed (\d+)", "canceled": r"canceled (\d+)", "ignored": r"ignored (\d+)"},
    "rubocop": {"files": r"(\d+) files? inspected", "offenses": r"(\d+) offenses?", "correctable": r"(\d+) offenses? autocorrectable"},
    "ruff": {"found": r"Found (\d+) errors?", "fixable": r"(\d+) fixable"},
    "eslint": {"errors": r"\((\d+) errors?", "warnings": r"(\d+) warnings?\)"},
    "git_diff": {"files": r"(\d+) files? changed", "insertions": r"(\d+) insertions?", "deletions": r"(\d+) deletions?"},
    "npm": {"added": r"added (\d+) packages?", "vulnerabilities": r"(\d+) vulnerabilit"},
    "terraform": {"add": r"(\d+) to add", "change": r"(\d+) to change", "destroy": r"(\d+) to destroy"},
    "prettier": {"unformatted": r"Code style issues found in (\d+) files?"},
    "ping": {"sent": r"(\d+) packets transmitted", "received": r"(\d+) (?:packets )?received"},
    "rsync": {"sent": r"sent ([\d,]+) bytes", "received": r"received ([\d,]+) bytes"},
}

# name: separator of the columns, and the columns shown
COLUMNS = {
    "docker_ps": (r"\s{2,}", (0, 1, 4, -1)),
    "docker_images": (r"\s{2,}", (0, 1, 4)),
    "kubectl": (r"\s{2,}", (0, 1, 2, 3)),
    "pip_list": (r"\s+", (0, 1)),
    "df": (r"\s+", (0, 1, 4, 5)),
    "ps": (r"\s+", (0, 1, 2, 3, 10)),
    "psql": (r"\s*\|\s*", (0, 1, 2, 3)),
    "sqlite": (r"\|", (0, 1, 2, 3)),
    "ls": (r"\s+", (0, 4, 8)),
    "tsv": (r"\t", (0, 1, 2, 3)),
}

# name: JSON path of the list, and the fields shown
RECORDS = {
    "pull_requests": ("$", ("number", "title", "author.login", "state")),
    "merge_requests": ("$", ("iid", "title", "author.username", "state")),
    "issues": ("$", ("number", "title", "state")),
    "workflow_runs": ("$", ("databaseId", "name", "status", "conclusion")),
    "ec2_instances": ("$.Instances", ("InstanceId", "InstanceType", "State.Name", "PrivateIpAddress")),
    "ecs_services": ("$.services", ("serviceName", "status", "runningCount", "desiredCount")),
    "rds_instances": ("$.DBInstances", ("DBInstanceIdentifier", "Engine", "EngineVersion", "DBInstanceStatus", "Endpoint.Address")),
    "cloudformation_stacks": ("$.StackSummaries", ("StackName", "StackStatus", "CreationTime")),
    "lambda_functions": ("$.Functions", ("FunctionName", "Runtime", "MemorySize", "Timeout")),
    "iam_roles": ("$.Roles", ("RoleName", "CreateDate")),
    "iam_users": ("$.Users", ("UserName", "CreateDate")),
    "s3_objects": ("$.Contents", ("Key", "Size", "LastModified")),
    "pods": ("$.items", ("metadata.namespace", "metadata.name", "status.phase")),
    "services": ("$.items", ("metadata.namespace", "metadata.name", "spec.type", "spec.clusterIP")),
    "rubocop": ("$.files", ("path", "offenses[0].cop_name")),
    "go_test": ("$", ("Action", "Package", "Test")),
    "eslint": ("$", ("filePath", "errorCount", "warningCount")),
    "golangci": ("$.Issues", ("FromLinter", "Pos.Filename", "Pos.Line", "Text")),
    "phpstan": ("$.files", ("path", "errors")),
}

# name: line that starts a block, line that goes on with it
SECTIONS = {
    "rust_errors": (r"^(error|warning)(\[|:)", r"^\s+\S|^\s*$"),
    "git_log": (r"^commit [0-9a-f]{7,40}", r"^(Author|Date|Merge):|^\s+\S|^$"),
    "git_files": (r"^diff --git ", r"^(?!diff --git )"),
    "cargo_failures": (r"^---- .+ stdout ----", r"^(?!----).*"),
    "pytest_failures": (r"^_{3,} .+ _{3,}$", r"^(?!_{3,}|={3,}).*"),
    "rspec_failures": (r"^\s+\d+\) ", r"^\s+(?!\d+\) )\S"),
    "gradle_failures": (r" FAILED$", r"^\s+\S"),
    "python_tracebacks": (r"^Traceback \(most recent call last\):", r"^\s+\S|^\w*(Error|Exception)\b"),
    "psql_records": (r"^-\[ RECORD \d+ \]", r"^\S+\s*\|"),
    "sbt_failures": (r"^\[info\] - .+ \*\*\* FAILED \*\*\*", r"^\[info\]\s{3,}\S"),
}


def _noise(name: str, match: str, strip: tuple[str, ...], most: int = 50, **more) -> Filter:
    return Filter(name=name, match_command=match, strip_ansi=True, strip_lines_matching=(r"^\s*$", *strip), max_lines=most, **more)


#: Filters by tool: blank lines, progress and banners go, long outputs are cut.
FILTERS = {
    f.name: f
    for f in (
        _noise("ansible-playbook", r"^ansible-playbook\b", (r"^ok: \[", r"^skipping: \[", r"^TASK \["), 60),
        _noise("basedpyright", r"^basedpyright\b", (r"^Searching", r"^Found \d+ source", r"^No configuration"), on_empty="ok"),
        _noise("biome", r"^biome\b", (r"^Checked \d+ file", r"^The number of diagnostics"), on_empty="ok"),
        _noise("brew-install", r"^brew\s+(install|upgrade)\b", (r"^==> (Downloading|Pouring|Fetching)", r"^#+", r"^Already downloaded"), 20),
        _noise("bundle-install", r"^bundle\s+(install|update)\b", (r"^Using ", r"^Fetching ", r"^Installing "), 30),
        _noise("composer-install", r"^composer\s+(install|update|require)\b", (r"^\s+- (Downloading|Installing|Locking)", r"^Loading composer"), 30),
        _noise("df", r"^df(\s|$)", (r"^(tmpfs|udev|devtmpfs|overlay)",), 20, truncate_lines_at=100),
        _noise("dotnet-build", r"^dotnet\s+build\b", (r"^MSBuild version", r"^Determining projects", r"^\s+Restored"), 40),
        _noise("du", r"^du\b", (), 40, truncate_lines_at=120),
        _noise("gcc", r"^g(cc|\+\+)\b", (r"^\s*\|", r"^In file included", r"^\s+from "), on_empty="ok"),
        _noise("gcloud", r"^gcloud\b", (), 30, truncate_lines_at=120),
        _noise("gradle", r"^(gradle|gradlew|\./gradlew)\b", (r"^> Task .*UP-TO-DATE", r"^Download ", r"^Starting a Gradle Daemon", r"^> Configure"), 50),
        _noise("hadolint", r"^hadolint\b", (), 40, truncate_lines_at=120),
        _noise("helm", r"^helm\b", (r"^NOTES:", r"^W\d{4}"), 40, truncate_lines_at=120),
        _noise("iptables", r"^iptables\b", (r"^target\s+prot", r"^num\s"), 50, truncate_lines_at=120),
        _noise("jira", r"^jira\b", (r"^-+$",), 40, truncate_lines_at=120),
        _noise("jj", r"^jj\b", (r"^Hint:", r"^Rebased ", r"^Working copy"), 30, truncate_lines_at=120),
        _noise("jq", r"^jq\b", (), 40, truncate_lines_at=120),
        _noise("just", r"^just\b", (r"^\s*#", r"^Available recipes"), truncate_lines_at=150),
        _noise("liquibase", r"(?:^|/)liquibase(?:\s|$)", (r"^#+", r"^Starting Liquibase", r"^Liquibase (Version|Open)"), 40),
        _noise("make", r"^make\b", (r"^make\[\d+\]: (Entering|Leaving)", r"^make: Nothing"), on_empty="ok"),
        _noise("markdownlint", r"^markdownlint\b", (), truncate_lines_at=120),
        _noise("mise", r"^mise\s+(run|exec|install)", (r"^mise .*(downloading|extracting)", r"^\[\w+\] \$"), 50),
        _noise("mix-compile", r"^mix\s+compile(\s|$)", (r"^Compiling \d+ file", r"^Generated "), 40, on_empty="ok"),
        _noise("mix-format", r"^mix\s+format(\s|$)", (), 20, on_empty="ok"),
        _noise("mvn-build", r"^mvn\s+(compile|package|clean|install|verify)", (r"^\[INFO\] (Download|---|Scanning|\s*$)", r"^\[INFO\]\s*-+"), 50),
        _noise("nx", r"^(pnpm\s+)?nx\b", (r"^\s*>\s+nx run", r"^\s*NX\s", r"Nx read the output from the cache"), 60, truncate_lines_at=150),
        _noise("oxlint", r"^oxlint\b", (r"^Finished in", r"^Found 0 "), on_empty="ok"),
        _noise("ping", r"^ping\b", (r"^PING ", r"^\d+ bytes from", r"^Request timeout"), 10, tail_lines=4),
        _noise("pio-run", r"^pio\s+run", (r"^(Compiling|Archiving|Linking|Indexing) ", r"^Verbose mode", r"^(CONFIGURATION|PLATFORM|HARDWARE|PACKAGES|LDF)"), 30, on_empty="ok"),
        _noise("poetry-install", r"^poetry\s+(install|lock|update)\b", (r"^\s+[-•] (Installing|Updating|Downloading)", r"^Resolving"), 30),
        _noise("pre-commit", r"^pre-commit\b", (r"\.Passed$", r"\.Skipped$", r"^\[INFO\]"), 40),
        _noise("ps", r"^ps(\s|$)", (r"\[k\w+",), 30, truncate_lines_at=120),
        _noise("pulumi", r"^pulumi\s+(up|preview|destroy|refresh|stack)(\s|$)", (r"^View (in Browser|Live)", r"^@ (previewing|updating|destroying)", r"^\s*Loading policy"), 60),
        _noise("quarto-render", r"^quarto\s+render", (r"^\s*(to|standalone|section-divs|html-math|default-image|wrap):", r"^pandoc$", r"^processing file"), 20),
        _noise("rsync", r"^rsync\b", (r"^sending incremental", r"/$", r"^\s+\d+%"), 20),
        _noise("shellcheck", r"^shellcheck\b", (r"^\s*\^-+",)),
        _noise("shopify-theme", r"^shopify\s+theme\s+(push|pull)", (r"^\s*(Uploading|Downloading)", r"^[│╭╰]"), 20),
        _noise("skopeo", r"^skopeo\b", (r"^(Getting image|Copying (blob|config)|Writing manifest|Storing sig)",), 30, truncate_lines_at=120, on_empty="ok"),
        _noise("sops", r"^sops\b", (), 40),
        _noise("spring-boot", r"^(mvn\s+spring-boot:run|java\s+-jar)", (r"^\s*[.\\/_' |(),]+$", r"\b(DEBUG|TRACE)\b"), 40),
        _noise("ssh", r"^ssh\b", (r"^Warning: Permanently added", r"^(Welcome to|Last login|\s*\* )", r"^debug\d:"), 200, truncate_lines_at=120),
        _noise("stat", r"^stat\b", (r"^\s*(Device|Birth|Context):",), 20, truncate_lines_at=120),
        _noise("swift-build", r"^swift\s+build\b", (r"^\[\d+/\d+\]", r"^(Fetching|Computing|Creating)"), 40),
        _noise("systemctl-status", r"^systemctl\s+status\b", (r"^\s+[├└│]",), 20),
        _noise("task", r"^task\b", (r"^task: \[",), truncate_lines_at=150, on_empty="ok"),
        _noise("terraform-plan", r"^(terraform|tofu)\s+plan", (r"Refreshing state\.\.\.", r"Reading\.\.\.", r"Read complete", r"^\s*#.*unchanged"), 80, on_empty="no changes"),
        _noise("tofu-init", r"^(terraform|tofu)\s+init(\s|$)", (r"^- (Finding|Installing|Reusing)", r"^Initializing"), 20),
        _noise("tofu-validate", r"^(terraform|tofu)\s+(validate|fmt)(\s|$)", (), 30, on_empty="ok"),
        _noise("trunk-build", r"^trunk\s+build", (r"^\s*Compiling", r"\bINFO\b"), 30, tail_lines=10, on_empty="ok"),
        _noise("turbo", r"^turbo\b", (r"^[•>]", r"cache (hit|miss|bypass)", r"^\s*(Packages|Running|Remote caching)"), truncate_lines_at=150, on_empty="ok"),
        _noise("ty", r"^ty\b", (r"^Checking", r"^Found 0"), on_empty="ok"),
        _noise("uv-sync", r"^uv\s+(sync|pip\s+install)\b", (r"^(Resolved|Prepared|Downloading|Building|Using|Audited) ",), 20, on_empty="ok"),
        _noise("xcodebuild", r"^xcodebuild\b", (r"^(Compile\w*|Ld|CodeSign|Process\w*|Copy\w*|Touch|Create\w*|Write\w*|Mkdir|Generate\w*|Emit\w*|Register\w*|Validate|Sign\w*) ", r"^\s+(cd|export|builtin|/)"), 60),
        _noise("yadm", r"^yadm\b", (r"^\s+\(use ", r"^(hint|On branch)"), 40, truncate_lines_at=120),
        _noise("yamllint", r"^yamllint\b", (), truncate_lines_at=120),
        _noise("fail2ban-client", r"^fail2ban-client\b", (), 30),
        _noise("fnm", r"^fnm\s+\w+", (r"^Installing", r"%"), 20),
        _noise("ollama", r"^ollama\s+run\b", (r"^(pulling|verifying|writing)", r"^[⠀-⣿\s]+$"), 200),
    )
}


def diagnostics(lines: DataFrame, tool: str) -> DataFrame:
    """doc_id, line_no, file, line, severity, code, message of the lines of the tool's form."""
    pattern, *groups = DIAGNOSTICS[tool]
    get = lambda g: F.regexp_extract("line", pattern, g) if g else F.lit("")
    file, number, severity, code, message = groups
    return lines.filter(F.col("line").rlike(pattern)).select("doc_id", "line_no", get(file).alias("file"), get(number).try_cast("long").alias("number"), F.lower(get(severity)).alias("severity"), get(code).alias("code"), get(message).alias("message"))


def by_code(found: DataFrame, most: int = 10) -> DataFrame:
    """The commonest codes of each output: doc_id, code, n, files and the first message."""
    groups = found.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.min_by("message", "line_no").alias("example"))
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= most)


def counters(lines: DataFrame, tool: str) -> DataFrame:
    """One row an output with the sums of the tool's counters over its lines."""
    value = lambda p: F.coalesce(F.regexp_replace(F.concat_ws("", *[F.regexp_extract("line", p, i + 1) for i in range(re.compile(p).groups)]), ",", "").try_cast("long"), F.lit(0))
    return lines.groupBy("doc_id").agg(*[F.sum(value(p)).alias(name) for name, p in COUNTERS[tool].items()])


def columns(lines: DataFrame, tool: str, header: bool = True) -> DataFrame:
    """doc_id, line_no, shown: the chosen columns of each row of a table, rulers and the header left out."""
    separator, chosen = COLUMNS[tool]
    cells = F.split(X.trim(F.col("line")), separator)
    shown = F.concat_ws(" ", *[F.element_at(cells, F.lit(i)) if i < 0 else F.get(cells, F.lit(i)) for i in chosen])
    rows = lines.filter(~F.col("line").rlike(r"^[-+\s=]*$") & ~F.col("line").rlike(r"^\(\d+ rows?\)$"))
    return rows.filter(F.col("line_no") > 0 if header else F.lit(True)).select("doc_id", "line_no", shown.alias("shown"))


def records(docs: DataFrame, kind: str, most: int = 20, text_col: str = "text") -> DataFrame:
    """doc_id, shown: a line for each of the first items of a JSON list, and how many more there are."""
    path, fields = RECORDS[kind]
    items = F.from_json(F.get_json_object(text_col, path), "array<string>")
    one = lambda item: F.concat_ws(" ", *[F.get_json_object(item, f"$.{f}") for f in fields])
    more = F.size(items) - most
    lines = F.concat(F.transform(F.slice(items, 1, most), one), F.when(more > 0, F.array(F.concat(F.lit("+"), more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    return docs.filter(items.isNotNull()).select("doc_id", F.array_join(lines, "\n").alias("shown"))


def sections(lines: DataFrame, kind: str) -> DataFrame:
    return runs.blocks(lines, *SECTIONS[kind])


def git_status(lines: DataFrame) -> DataFrame:
    """Files by state of porcelain status lines: doc_id, state, n."""
    state = F.when(F.col("line").startswith("??"), "untracked").when(F.col("line").rlike("^(U.|.U|AA|DD)"), "conflict").when(F.col("line").rlike("^[MADRC]"), "staged").when(F.col("line").rlike("^ [MD]"), "changed")
    return lines.withColumn("state", state).filter("state is not null").groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("n"))


def remote_only(branches: DataFrame) -> DataFrame:
    """Remote branches without a local one, by lines of a branch listing."""
    name = F.regexp_replace(X.trim(F.col("line")), r"^\* ", "")
    named = branches.filter(~F.col("line").contains("->")).select("doc_id", name.alias("name"))
    remote = named.filter(F.col("name").startswith("remotes/")).select("doc_id", F.regexp_replace("name", "^remotes/[^/]+/", "").alias("name"))
    return remote.distinct().join(named.filter(~F.col("name").startswith("remotes/")), ["doc_id", "name"], "left_anti")


def by_extension(lines: DataFrame) -> DataFrame:
    """Files of a listing by extension."""
    extension = F.regexp_extract("line", r"[^/]\.([A-Za-z0-9]+)$", 1)
    return lines.groupBy("doc_id", F.when(extension == "", "none").otherwise(F.lower(extension)).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def by_directory(lines: DataFrame, dirs: int = 20, names: int = 10) -> DataFrame:
    """Paths by directory: doc_id, dir, n and the first names."""
    split = lines.select("doc_id", F.regexp_extract("line", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("line", r"([^/]*)$", 1).alias("name"))
    groups = split.groupBy("doc_id", "dir").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, names).alias("names"))
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("dir"))).filter(F.col("rank") <= dirs)


def mask_environment(lines: DataFrame) -> DataFrame:
    """name, group and value of NAME=value lines; values of sensitive names are masked."""
    name, value = F.regexp_extract("line", r"^([A-Za-z_]\w*)=", 1), F.regexp_extract("line", r"^[^=]*=(.*)$", 1)
    secret = F.upper(name).rlike("TOKEN|SECRET|PASSWORD|PASSWD|KEY|CREDENTIAL|AUTH")
    group = F.when(name.rlike("PATH$"), "path").when(name.rlike("^(PYTHON|NODE|GO|JAVA|RUBY|RUST|CARGO)"), "language").when(name.rlike("^(AWS|GCP|AZURE|GOOGLE|KUBE|DOCKER)"), "cloud").when(name.rlike("^(GIT|EDITOR|VISUAL|PAGER|SHELL|TERM)"), "tool").otherwise("other")
    return lines.filter(name != "").select("doc_id", name.alias("name"), group.alias("group"), F.when(secret, X.mask(value)).otherwise(value).alias("value"))


def severity_share(column: Column) -> Column:
    return F.avg(X.severity(column).isin("error", "fatal").cast("double"))
