"""Commits and diffs: what changed, which lines a fix took out, and what an upgrade was followed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver
from ..functions import text as T
from . import graphs


# How the name, address or login of a bot looks.
BOTS = r"(?i)\[bot\]|^renovate( bot)?\z|^dependabot\z|@renovateapp\.com\z|@dependabot\.com\z|^bot@"


def is_bot(author: Column, email: Column, login: Column) -> Column:
    return F.exists(F.array(author, email, login), lambda x: F.coalesce(x.rlike(BOTS), F.lit(False)))


def is_merge(parents: Column) -> Column:
    return parents > 1


# Titles of pull requests that bump several packages at once, and paths of test files.
GROUPED_TITLE = r"(?i)\bnon[- ]?major\b|\ball\b.*\b(?:dependencies|updates)\b|\block ?file maintenance\b"
TEST_FILE = r"(?i)(?:^|/)(?:__tests__|__mocks__|tests?|specs?|e2e|cypress|playwright|__snapshots__)/|\.(?:test|spec|e2e|cy|stories)\.[cm]?[jt]sx?\z|(?:^|/)(?:vitest|jest|playwright)\.(?:setup|config)[^/]*\z"


def is_grouped(title: Column) -> Column:
    return title.rlike(GROUPED_TITLE)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def unquoted(path: Column) -> Column:
    """A path as git quotes it in a diff: C escapes and octal bytes of UTF-8 between quotes."""
    inner = F.regexp_extract(path, r'^"(.*)"\z', 1)
    parts = F.regexp_extract_all(inner, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    # C escapes.
    plain = {"n": "0A", "t": "09", "r": "0D", "a": "07", "b": "08", "f": "0C", "v": "0B"}
    short = lambda x: F.coalesce(F.create_map(*[F.lit(y) for k, v in plain.items() for y in (k, v)])[F.substring(x, 2, 1)], F.hex(F.substring(x, 2, 1)))
    octal = lambda x: F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0")
    digits = F.transform(parts, lambda x: F.when(x.rlike(r"^\\[0-7]{3}"), octal(x)).when(F.startswith(x, F.lit("\\")), short(x)).otherwise(F.hex(x)))
    return F.when(path.rlike('^".*"\\z'), F.decode(F.unhex(F.array_join(digits, "")), "UTF-8")).otherwise(path)


def diff_lines(diffs: DataFrame) -> DataFrame:
    """id, file, side (old, new), line, text of unified diffs (id, diff): numbers run on from each hunk's head.

    Context lines are on neither side. Rows of one diff are numbered within its hunks by running counts.
    """
    each = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    by = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file_head = F.col("raw").rlike(r"^diff --git ")
    hunk = F.col("raw").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    told = each.withColumns({"file_no": F.sum(file_head.cast("int")).over(by), "hunk_no": F.sum((file_head | hunk).cast("int")).over(by), "is_hunk": hunk})
    own = Window.partitionBy("id", "hunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda sign: F.max(F.when(hunk, F.regexp_extract("raw", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", sign).cast("int"))).over(own)
    mark = F.substring("raw", 1, 1)
    in_hunk = F.max("is_hunk").over(own) & ~F.col("is_hunk")
    counted = told.withColumns({"inside": in_hunk, "mark": mark, "old0": start(1), "new0": start(2)})
    counted = counted.withColumns({"old_n": F.sum((F.col("inside") & F.col("mark").isin("-", " ")).cast("int")).over(own), "new_n": F.sum((F.col("inside") & F.col("mark").isin("+", " ")).cast("int")).over(own)})
    path = Window.partitionBy("id", "file_no")
    head = lambda mark: F.regexp_replace(unquoted(F.regexp_extract("raw", rf"^{mark} ([^\t]*?)\s*(?:\t.*)?\z", 1)), "^[ab]/", "")
    named = counted.withColumns({"old_path": F.max(F.when(~F.col("inside"), head("---"))).over(path), "new_path": F.max(F.when(~F.col("inside"), head(r"\+\+\+"))).over(path)})
    side = F.when(F.col("mark") == "-", "old").when(F.col("mark") == "+", "new")
    return named.filter("inside").withColumn("side", side).filter("side is not null").select("id", F.when(F.col("side") == "old", F.col("old_path")).otherwise(F.col("new_path")).alias("file"), "side", F.when(F.col("side") == "old", F.col("old0") + F.col("old_n") - 1).otherwise(F.col("new0") + F.col("new_n") - 1).alias("line"), F.expr("substring(raw, 2)").alias("text"))


def expected_lines(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """id, file, line, packages: meaningful lines that a fix took out of files that import an upgraded package.

    changed: id, file, side, line, text; imports: id, file, package.
    """
    uses = imports.groupBy("id", "file").agg(F.array_sort(F.collect_set("package")).alias("packages"))
    return changed.filter((F.col("side") == "old") & T.is_meaningful(F.col("text"))).join(uses, ["id", "file"]).select("id", "file", "line", "packages")


#: Share of expected lines that only moved layout from which a fix is a formatter's.
REFORMAT_SHARE = 0.5

# Why the commits of a pull request don't split into an upgrade and its fix.
NO_SPLIT = ["no human commit", "first commit is not by a bot", "merge commit before the fix"]


def branch(commits: DataFrame) -> DataFrame:
    """id, reason, upgraded, fix_from, fix_to, fixes: how the commits of a pull request split into the upgrade and the fix on top of it.

    commits: id, pos, bot boolean, parents int. The fix begins with the first commit by a person (no bot, no merge) and ends with the
    last one before the next merge; upgraded is the place of the commit before it, whoever wrote it; fixes counts the
    commits by persons. Where there is no such split the reason says why and the places are null.
    """
    person = ~F.col("bot") & (F.col("parents") <= 1)
    merge = F.col("parents") > 1
    first = commits.groupBy("id").agg(F.min(F.when(person, F.col("pos"))).alias("fix_from"), F.min_by("bot", "pos").alias("begun_by_bot"))
    met = commits.join(first, "id")
    at = met.groupBy("id", "begun_by_bot", "fix_from").agg(
        F.max(F.when(F.col("pos") < F.col("fix_from"), F.col("pos"))).alias("upgraded"),
        F.coalesce(F.bool_or(merge & (F.col("pos") < F.col("fix_from"))), F.lit(False)).alias("merged_before"),
        F.min(F.when(merge & (F.col("pos") > F.col("fix_from")), F.col("pos"))).alias("merge"),
    )
    run = met.filter(person).join(at.select("id", "merge"), "id").filter(F.col("merge").isNull() | (F.col("pos") < F.col("merge")))
    ends = run.groupBy("id").agg(F.max("pos").alias("fix_to"), F.count(F.lit(1)).alias("fixes"))
    reason = F.when(F.col("fix_from").isNull(), NO_SPLIT[0]).when(F.col("upgraded").isNull() | ~F.col("begun_by_bot"), NO_SPLIT[1]).when(F.col("merged_before"), NO_SPLIT[2])
    told = at.join(ends, "id", "left").withColumn("reason", reason)
    return told.select("id", "reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("upgraded", "fix_from", "fix_to", "fixes")])


def bumps(before: DataFrame, after: DataFrame) -> DataFrame:
    """manifest, key, from, to, bump: locked versions that went up between two commits."""
    a, b = before.select("manifest", "key", F.col("version").alias("from")), after.select("manifest", "key", F.col("version").alias("to"))
    return a.join(b, ["manifest", "key"]).filter(semver.key("to") > semver.key("from")).select("manifest", "key", "from", "to", semver.bump("from", "to").alias("bump")).distinct()


def release_groups(upgrades: DataFrame) -> DataFrame:
    """group, packages, bump: upgrades of one repository, else of one scope and version, else each its own; the largest bump.

    upgrades: name, to, repository, bump.
    """
    scope = F.regexp_extract("name", r"^(@[^/]+)/", 1)
    group = F.coalesce(F.col("repository"), F.when(scope != "", F.concat(scope, F.lit("@"), F.col("to"))), F.col("name"))
    rank = F.when(F.col("bump") == "major", 2).when(F.col("bump") == "minor", 1).otherwise(0)
    return upgrades.groupBy(group.alias("group")).agg(F.array_sort(F.collect_set("name")).alias("packages"), F.max_by("bump", rank).alias("bump"))


def labels(expected: DataFrame) -> DataFrame:
    """id, lines, layout_share, tests_only, and lines and layout_share of source and of tests apart (null where there are none).

    expected: id, file, line, layout boolean. Shares of lines that only move layout are rounded to two places.
    """
    layout = F.col("layout").cast("double")
    told = expected.withColumn("test", is_test_path(F.col("file")))
    of = lambda name, cond: [F.count_if(cond).alias(f"{name}_lines"), F.round(F.avg(F.when(cond, layout)), 2).alias(f"{name}_layout_share")]
    return told.groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(layout), 2).alias("layout_share"), F.bool_and("test").alias("tests_only"), *of("source", ~F.col("test")), *of("test", F.col("test")))


def accepted(mined: DataFrame, ladder: list[tuple[str, Column]]) -> DataFrame:
    """mined with reason: the first rung that holds, null for what is accepted."""
    out = F.lit(None).cast("string")
    for code, flag in reversed(ladder):
        out = F.when(flag, F.lit(code)).otherwise(out)
    return mined.withColumn("reason", out)


# Why a pull request of a bot makes no case, behind those of NO_SPLIT, in the order in which they are asked.
NO_CASE = ["git fetch failed", "could not read the lockfiles", "no dependency upgraded", "several releases upgraded", "fix changes no source file", "fix only adds lines", "no changed file imports an upgraded package", "fix too large", "fix is mostly a reformat"]


def mined(candidates: DataFrame, most_groups: int, most_lines: int) -> DataFrame:
    """candidates with reason: null for a case, else the first of the twelve that holds.

    Columns: split (a reason of `branch`, or null), fetched and locks_read (null: no), packages and groups (how many were upgraded, of how
    many releases: `release_groups`), source_files (that the fix changes), removed (lines that it takes out), expected (those of files
    that import an upgraded package: `expected_lines`), layout_share (of the expected ones, `labels`). A count that isn't known is none.
    """
    n = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rungs = [no("fetched"), no("locks_read"), n("packages") == 0, (n("packages") > 1) & (n("groups") > most_groups), n("source_files") == 0, n("removed") == 0, n("expected") == 0, n("expected") > most_lines, F.coalesce("layout_share", F.lit(0.0)) >= REFORMAT_SHARE]
    told = accepted(candidates, list(zip(NO_CASE, rungs, strict=True)))
    return told.withColumn("reason", F.coalesce("split", "reason"))


def evidence(expected: DataFrame, added: DataFrame, facts: DataFrame) -> DataFrame:
    """id, package, on_site, options, types, imports (`file:line` of expected lines), names: what ties a fix to a package; only packages with some.

    expected: id, file, line, text, packages array; added: id, file, text; facts: id, package, kind (site, option, type,
    import or name), file, line, name. A name counts where a line of the files that import the package has it, not inside a
    longer word: names and lines meet by the name's longest token, and a name of several tokens is then looked for in the line.
    """
    own = expected.select("id", "file", "line", "text", F.explode("packages").alias("package"))
    at = facts.filter("kind <> 'name'").select("id", "package", "kind", "file", "line").distinct()
    lines_ = own.join(at, ["id", "package", "file", "line"]).withColumn("place", F.concat_ws(":", "file", F.col("line").cast("string")))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("place"))))
    placed = lines_.groupBy("id", "package").agg(of("site").alias("on_site"), of("option").alias("options"), of("type").alias("types"), of("import").alias("imports"))
    files = own.select("id", "package", "file").distinct()
    texts = own.select("id", "package", "text").unionByName(added.join(files, ["id", "file"]).select("id", "package", "text")).distinct()
    texts = graphs.written(texts.withColumn("row", F.monotonically_increasing_id()), "fix-lines")
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"[\w$]+|[^\w$\s]"), F.lit(0))
    longest = F.element_at(F.array_sort(tokens(F.col("name")), lambda x, y: F.length(y) - F.length(x)), 1)
    wanted = facts.filter("kind = 'name'").select("id", "package", "name").distinct().withColumn("token", longest).filter("token is not null")
    each = texts.select("id", "package", "row", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    met = each.join(wanted, ["id", "package", "token"]).withColumn("sure", (F.col("name") == F.col("token")) & F.col("name").rlike(r"[\w$]"))
    whole = F.concat(F.lit(r"(?<![\w$])"), F.regexp_replace("name", r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"(?![\w$])"))
    doubtful = met.filter("not sure").join(texts.select("row", "text"), "row").filter(F.rlike("text", whole))
    found = met.filter("sure").select("id", "package", "name").unionByName(doubtful.select("id", "package", "name")).distinct()
    named = found.groupBy("id", "package").agg(F.array_sort(F.collect_list("name")).alias("names"))
    none = F.array().cast("array<string>")
    both = placed.join(named, ["id", "package"], "full").select("id", "package", *[F.coalesce(c, none).alias(c) for c in ("on_site", "options", "types", "imports", "names")])
    return both.filter(F.size(F.concat("on_site", "options", "types", "imports", "names")) > 0)



def checked(cases: DataFrame, found: DataFrame) -> DataFrame:
    """id, check: reformat, weak or supported. cases: id, layout_share; found: rows of evidence()."""
    met = cases.join(found.select("id").distinct().withColumn("tied", F.lit(True)), "id", "left")
    return met.select("id", F.when(F.col("layout_share") >= REFORMAT_SHARE, "reformat").when(F.coalesce("tied", F.lit(False)), "supported").otherwise("weak").alias("check"))


def counted(cases: DataFrame, every: bool = False) -> DataFrame:
    """The cases that a score counts: supported ones, or all."""
    return cases if every else cases.filter("check = 'supported'")


def histogram(rows: DataFrame) -> DataFrame:
    """repo, a count for each verdict, adapted (upgrades followed by a change of code) and suspects (quiet ones among them).

    rows: repo, verdict, adapted array, follow_ups array.
    """
    touched = (F.size("adapted") > 0) | (F.size("follow_ups") > 0)
    counts = [F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in ("quiet", "review", "blocked", "not-analysed")]
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("upgrades"), *counts, F.count_if(touched).alias("adapted"), F.count_if(touched & (F.col("verdict") == "quiet")).alias("suspects"))
