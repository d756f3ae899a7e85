"""Notes, history and usage operators on small tables."""

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import lines, matching, history, notes, scoring, usage


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows_of(df, *columns):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect()}


def test_waterfall_keeps_every_version(spark):
    wanted = frame(spark, "pkg string, version string", ("a", "1"), ("a", "2"), ("a", "3"))
    kind = "pkg string, version string, body string, reason string"
    first = frame(spark, kind, ("a", "1", "one", None), ("a", "2", " ", "empty"))
    second = frame(spark, kind, ("a", "2", "two", None), ("a", "1", "other", None))
    found = notes.waterfall(wanted, [("releases", first), ("changelog", second)])
    assert rows_of(found, "version", "body", "found_in", "reason") == {("1", "one", "releases", None), ("2", "two", "changelog", None), ("3", None, None, "releases: not found; changelog: not found")}
    ranges = frame(spark, "pkg string, version string", ("a", "1"), ("a", "3"), ("b", "9"), ("c", None))
    assert rows_of(notes.coverage(ranges, found), "pkg", "coverage") == {("a", "partial"), ("b", "unavailable"), ("c", "complete")}
    told = frame(spark, "pkg string, version string, body string, status string", ("b", "9", None, "not-published"), ("a", "3", None, "not-published"), ("a", "1", None, None))
    assert rows_of(notes.coverage(ranges, told), "pkg", "coverage") == {("a", "unavailable"), ("b", "none-published"), ("c", "complete")}


def test_tags(spark):
    versions = frame(spark, "pkg string, version string", ("@s/a", "1.0.0"), ("@s/a", "2.0.0"), ("b", "1.0.0"))
    tagged = frame(spark, "pkg string, tag string", ("@s/a", "a@1.0.0"), ("@s/a", "v1.0.0"), ("@s/a", "@s/a-v2.0.0"), ("@s/a", "a-v2.0.0"), ("b", "b-1.0.0"))
    found = notes.tags(versions.unionByName(frame(spark, "pkg string, version string", ("@s/a", "3.0.0"))), tagged)
    assert rows_of(found, "pkg", "version", "tag", "scheme") == {("@s/a", "1.0.0", "v1.0.0", 0), ("@s/a", "2.0.0", "@s/a-v2.0.0", 4), ("@s/a", "3.0.0", None, None), ("b", "1.0.0", None, None)}


def test_headings_and_sections(spark):
    body = "# Changelog\n\n## 2.0.0\ntext\n### Breaking\n- x\n```\n# no heading\n```\n1.5.0\n-----\n- y\n## 1.0.0 - old\nz\n## 2.0.0\nagain"
    bodies = frame(spark, "pkg string, body string", ("p", body))
    assert rows_of(notes.headings(bodies, "pkg", "body"), "pos", "level", "title") == {(0, 1, "Changelog"), (2, 2, "2.0.0"), (4, 3, "Breaking"), (9, 2, "1.5.0"), (12, 2, "1.0.0 - old"), (14, 2, "2.0.0")}
    assert rows_of(notes.sections(bodies, "pkg", "body"), "version", "first", "last") == {("2.0.0", 3, 8), ("1.5.0", 11, 11), ("1.0.0", 13, 13)}


def test_medians_of_any_size(spark):
    rows = [("a", v) for v in (1.0, 2.0, 2.0, 9.0)] + [("b", 3.0), ("c", None), (None, 4.0), (None, 6.0)] + [("d", float(v)) for v in range(101)]
    found = scoring.medians(frame(spark, "k string, v double", *rows), "k", "v")
    assert rows_of(found, "k", "n", "median", "upper_median") == {("a", 4, 2.0, 2.0), ("b", 1, 3.0, 3.0), (None, 2, 5.0, 6.0), ("d", 101, 50.0, 50.0)}


def test_diff_lines(spark):
    diff = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -3,3 +3,4 @@ f\n keep\n-old line\n+new line\n+more\n keep\n@@ -20 +21 @@\n-gone\n+here\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- dashes\n-b"
    found = history.diff_lines(frame(spark, "id int, diff string", (1, diff)))
    assert rows_of(found, "file", "side", "line", "text") == {("x.ts", "old", 4, "old line"), ("x.ts", "new", 4, "new line"), ("x.ts", "new", 5, "more"), ("x.ts", "old", 20, "gone"), ("x.ts", "new", 21, "here"), ("y", "old", 1, "-- dashes"), ("y", "old", 2, "b")}
    imports = frame(spark, "id int, file string, package string", (1, "x.ts", "p"), (1, "x.ts", "o"))
    assert rows_of(history.expected_lines(found, imports), "file", "line", "packages") == {("x.ts", 4, ("o", "p")), ("x.ts", 20, ("o", "p"))}


def test_branches_and_groups(spark):
    bot, person, merge = (True, 1), (False, 1), (False, 2)
    prs = {1: [bot, person, person, merge, person], 2: [bot], 3: [bot, bot, person], 4: [person, person], 5: [bot, merge, person], 6: [bot, person, bot, person, (True, 2), person], 7: [merge, person], 8: [bot, bot, merge]}
    commits = frame(spark, "id int, pos int, bot boolean, parents int", *[(i, pos, *c) for i, cs in prs.items() for pos, c in enumerate(cs)])
    none, by_person, merged = history.NO_SPLIT
    assert rows_of(history.branch(commits), "id", "reason", "upgraded", "fix_from", "fix_to", "fixes") == {
        (1, None, 0, 1, 2, 2), (2, none, None, None, None, None), (3, None, 1, 2, 2, 1), (4, by_person, None, None, None, None), (5, merged, None, None, None, None), (6, None, 0, 1, 3, 2), (7, by_person, None, None, None, None), (8, none, None, None, None, None),
    }
    cut = history.labels(frame(spark, "id int, file string, line int, layout boolean", (1, "src/a.ts", 1, True), (1, "src/a.ts", 2, False), (1, "tests/b.ts", 1, True), (2, "tests/b.ts", 1, False)))
    assert rows_of(cut, "id", "lines", "layout_share", "tests_only", "source_lines", "source_layout_share", "test_lines", "test_layout_share") == {(1, 3, 0.67, False, 2, 0.5, 1, 1.0), (2, 1, 0.0, True, 0, None, 1, 0.0)}
    kind = "manifest string, key string, version string"
    found = history.bumps(frame(spark, kind, ("m", "a", "1.9.0"), ("m", "b", "2.0.0")), frame(spark, kind, ("m", "a", "1.10.0"), ("m", "b", "1.0.0"), ("m", "c", "1.0.0")))
    assert rows_of(found, "key", "from", "to", "bump") == {("a", "1.9.0", "1.10.0", "minor")}
    groups = history.release_groups(frame(spark, "name string, to string, repository string, bump string", ("a", "1", "r", "patch"), ("b", "2", "r", "major"), ("@s/x", "3", None, "minor"), ("@s/y", "3", None, "patch"), ("z", "1", None, "patch")))
    assert rows_of(groups, "group", "packages", "bump") == {("r", ("a", "b"), "major"), ("@s@3", ("@s/x", "@s/y"), "minor"), ("z", ("z",), "patch")}
    rung = history.accepted(frame(spark, "n int", (1,), (5,), (9,)), [("few", F.col("n") < 3), ("odd", F.col("n") == 9)])
    assert rows_of(rung, "n", "reason") == {(1, "few"), (5, None), (9, "odd")}
    bots = frame(spark, "i int, a string, e string, l string", (1, "renovate[bot]", None, None), (2, "Jo", "jo@x", "jo"))
    assert [r[0] for r in bots.orderBy("i").select(history.is_bot(F.col("a"), F.col("e"), F.col("l"))).collect()] == [True, False]


def test_attribution_through_files(spark):
    imports = frame(spark, "file string, local string, specifier string, imported string", ("src/a.ts", "x", "../lib/proxy", "thing"), ("src/a.ts", "y", "pkg/sub", "default"), ("src/a.ts", "z", "./none", "n"), ("src/a.ts", "q", "../lib/proxy", "other"))
    files = frame(spark, "path string", ("src/a.ts",), ("lib/proxy.ts",), ("lib/more/index.ts",))
    installed = frame(spark, "pkg string", ("pkg",), ("deep",))
    found = usage.resolved(imports, files, installed)
    assert rows_of(found, "local", "target", "pkg", "unresolved") == {("x", "lib/proxy.ts", None, False), ("y", None, "pkg", False), ("z", None, None, True), ("q", "lib/proxy.ts", None, False)}
    handed = frame(spark, "file string, name string, imported string, target string, pkg string", ("lib/proxy.ts", "thing", "orig", "lib/more/index.ts", None), ("lib/proxy.ts", "*", "*", None, "deep"), ("lib/more/index.ts", "orig", "real", None, "pkg"), ("lib/more/index.ts", "loop", "loop", "lib/more/index.ts", None))
    origin = usage.origins(handed)
    assert ("lib/proxy.ts", "thing", "pkg", "real") in rows_of(origin, "file", "name", "pkg", "imported")
    references = frame(spark, "file string, local string, line int, col int", ("src/a.ts", "x", 3, 1), ("src/a.ts", "y", 4, 1), ("src/a.ts", "w", 5, 1))
    assert rows_of(usage.attributed(references, found, origin), "line", "pkg", "imported", "via") == {(3, "pkg", "real", "lib/proxy.ts"), (4, "pkg", "default", None)}


@pytest.mark.parametrize("path,want", [("src/../lib/./x", "lib/x"), ("../x", None), ("a//b", "a/b")])
def test_normalized(spark, path, want):
    assert frame(spark, "p string", (path,)).select(usage.normalized(F.col("p"))).first()[0] == want


def test_tools_and_facts(spark):
    scripts = frame(spark, "manifest string, script string", ("m", "lint && (build --x)|run"))
    assert rows_of(usage.tools_used(scripts, frame(spark, "pkg string, bin string", ("p", "build"), ("q", "other"))), "pkg", "manifest") == {("p", "m")}
    kind = "pkg string, path string, name string, fp string"
    before = frame(spark, kind, ("p", "f", "u", "1"), ("p", "f", "v", "2"), ("p", "g", "u", "1"), ("p", "old", "w", "1"))
    after = frame(spark, kind, ("p", "f", "u", "1"), ("p", "f", "v", "3"), ("p", "g", "u", "1"))
    changed = usage.changed_exports(before, after)
    assert rows_of(changed, "path", "names") == {("f", ("v",))}
    share = usage.changed_share(before, changed)
    assert [round(r.share, 3) for r in share.collect()] == [0.333]
    unplaced = frame(spark, "pkg string, entry int, names array<string>", ("p", 1, ["v", "zz"]), ("p", 2, ["u"]))
    assert rows_of(usage.hints(unplaced, changed, share, gate=0.5), "entry", "path") == {(1, "f")}
    assert usage.hints(unplaced, changed, share).count() == 0
    edges = frame(spark, "pkg string, version string, src int, dst int", ("p", "1", 1, 2), ("p", "1", 2, 1), ("q", "1", 1, 3))
    seen, cut = usage.reach(frame(spark, "pkg string, version string, path string, unit int", ("p", "1", "f", 1)), edges)
    assert seen.count() == 2 and not cut


def test_tags_asked_one_by_one(spark):
    """Against a loop over the versions of each package, with random pages and answers."""
    import random

    rnd = random.Random(8)
    spell = lambda v: [f"v{v}", v, f"q@{v}", f"q@{v}", f"q-v{v}", f"q-v{v}", f"release-{v}"]
    versions, page, answers, want = [], [], [], set()
    for k in range(25):
        pkg = "q" if k == 0 else f"q{k}"
        spell = lambda v, p=pkg: [f"v{v}", v, f"{p}@{v}", f"{p}@{v}", f"{p}-v{v}", f"{p}-v{v}", f"release-{v}"]
        own = [f"1.{n}.0" for n in range(rnd.randint(1, 9))]
        tags_ = {rnd.choice(spell(v)) for v in own if rnd.random() < 0.25}
        said = {t: rnd.choice(["found", "rate-limited"]) for v in own for t in spell(v) if rnd.random() < 0.2}
        versions += [(pkg, v) for v in own]
        page += [(pkg, t) for t in tags_]
        answers += [(pkg, t, o) for t, o in said.items()]
        scheme = next((next(i for i, t in enumerate(spell(v)) if t in tags_) for v in own if tags_ & set(spell(v))), None)
        count = 0
        for v in own:
            if tags_ & set(spell(v)):
                continue
            if count >= 12:
                want.add((pkg, v, (), None, None, True))
                continue
            asked, tag, failure = [], None, None
            for t in spell(v)[:3] if scheme is None else [spell(v)[scheme]]:
                asked.append(t)
                if t in said:
                    tag, failure = (t, None) if said[t] == "found" else (None, said[t])
                    break
            count += len(asked)
            want.add((pkg, v, tuple(asked), tag, failure, False))
    found = notes.lookups(frame(spark, "pkg string, version string", *versions), frame(spark, "pkg string, tag string", *page), frame(spark, "pkg string, tag string, outcome string", *answers))
    assert rows_of(found, "pkg", "version", "asked", "tag", "failure", "skipped") == want
    assert any(r[5] for r in want) and any(r[3] for r in want) and any(r[4] for r in want)


def test_spellings_on_disk(spark):
    found = frame(spark, "p string", ("a/b.mjs",)).select(usage.spelled(F.col("p"))).first()[0]
    assert found[:3] == ["a/b.mjs", "a/b.mjs.ts", "a/b.mjs.tsx"] and found.index("a/b.mts") < found.index("a/b.ts") < found.index("a/b.mjs/index.ts")


def test_removals_described(spark):
    kind = "pkg string, path string, kind string, deprecated boolean, alias_of string"
    before = frame(spark, kind, ("p", "p:ns", "namespace", False, None), ("p", "p:ns.a", "function", False, None), ("p", "p:Old", "class", True, None), ("p", "p:Old#x", "method", False, None), ("p", "p:Mine", "class", False, "p:Mid"), ("p", "p:Mid", "class", False, "p:Old"), ("p", "p:Mine#y", "method", False, None), ("p", "p:plain", "function", False, None), ("p", "p/eq:z", "function", False, None), ("p", "p/fn:", "function", False, None), ("p", "p/fn:w", "function", False, None))
    gone = frame(spark, "pkg string, path string, also_at array<string>", *[("p", x, []) for x in ("p:ns", "p:ns.a", "p:Old#x", "p:Mine#y", "p/eq:z", "p/fn:w")], ("p", "p:plain", ["p:Old.plain"]))
    entries = lambda *rows: frame(spark, "pkg string, prefix string, export_equals boolean", *rows)
    found = matching.removal_facts(gone, before, entries(("p", "p", False), ("p", "p/eq", True), ("p", "p/fn", True)), entries(("p", "p", False), ("p", "p/eq", False)))
    assert rows_of(found, "path", "namespace", "was_deprecated") == {("p:ns", True, False), ("p:ns.a", False, False), ("p:Old#x", False, True), ("p:Mine#y", False, True), ("p/eq:z", True, False), ("p/fn:w", False, False), ("p:plain", False, True)}
    told = frame(spark, "pkg string, entry string, bucket string, direct boolean, regions array<struct<kind:string,text:string>>", ("p", "n", "unattributed-breaking", False, [("title", "The old namespace is gone")]), ("p", "o", "unattributed-breaking", False, [("title", "Engines")]), ("q", "d", "unattributed-breaking", False, [("title", "Deprecated things left")]))
    ties = matching.removals_tied(told, found, by=["pkg"])
    assert rows_of(matching.with_tied(told, ties), "entry", "bucket", "tied") == {("n", "matched", ("ns", "z")), ("o", "unattributed-breaking", ()), ("d", "unattributed-breaking", ())}


def test_commits_that_adapt(spark):
    import datetime

    at = lambda day: datetime.datetime(2025, 1, 1) + datetime.timedelta(days=day)
    commits = [("r", f"c{d:02}", at(d), s) for d, s in [(0, "bump ring"), (1, "Adapt to RING 2"), (2, "Revert everything"), (3, "ringing"), (4, "use ring more"), (14, "ring much later"), *[(5, f"other {k}") for k in range(0)]]]
    commits += [("r", f"d{k}", at(4.5), "noise") for k in range(7)] + [("s", "e", at(1), "ring in another repository"), ("r", "z", at(6), "ring beyond ten")]
    upgrades = frame(spark, "repo string, id string, at timestamp, pkg string", ("r", "c00", at(0), "@scope/ring"), ("r", "c00", at(0), "pool"))
    touched = frame(spark, "id string, pkg string", *[(c[1], "@scope/ring") for c in commits if c[1] != "c04"], ("c02", "pool"))
    found = lines.adapting_followups(upgrades, frame(spark, "repo string, id string, at timestamp, subject string", *commits), touched)
    assert rows_of(found, "id", "pkg", "next_id", "rank") == {("c00", "@scope/ring", "c01", 1), ("c00", "@scope/ring", "c02", 2), ("c00", "pool", "c02", 2)}


def test_why_a_pull_request_makes_no_case(spark):
    names = ["split", "fetched", "locks_read", "packages", "groups", "source_files", "removed", "expected", "layout_share"]
    good = dict(zip(names, [None, True, True, 2, 1, 3, 5, 4, 0.2], strict=True))
    changes = [{}, {"split": "merge commit before the fix", "fetched": False}, {"fetched": None, "packages": 0}, {"locks_read": False}, {"packages": 0}, {"groups": 3}, {"packages": 1, "groups": 9}, {"source_files": 0, "removed": 0}, {"removed": 0}, {"expected": None}, {"expected": 11, "layout_share": 1.0}, {"layout_share": 0.5}]
    rows = [(i, *(good | c).values()) for i, c in enumerate(changes)]
    found = history.mined(spark.createDataFrame(rows, "i int, split string, fetched boolean, locks_read boolean, packages int, groups int, source_files int, removed int, expected int, layout_share double"), 2, 10)
    c = history.NO_CASE
    assert [r.reason for r in found.orderBy("i").collect()] == [None, "merge commit before the fix", c[0], c[1], c[2], c[3], None, c[4], c[5], c[6], c[7], c[8]]
    assert len(history.NO_SPLIT + history.NO_CASE) == 12
