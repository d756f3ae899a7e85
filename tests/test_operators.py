"""Operators on small tables: what each rule decides, ties and nulls included."""

import pytest
from pyspark.sql import functions as F

from shiftscope.functions import numbers, paths, semver
from shiftscope.functions import text as T
from shiftscope.operators import graphs, lines, matching, surfaces, verdicts, versions


def column(spark, values, make, kind="string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    n = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} {kind}" for k in range(n)))
    return [r[0] for r in df.orderBy("i").select(make(*[F.col(f"c{k}") for k in range(n)])).collect()]


def test_version_order(spark):
    rising = ["junk", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.9.0", "1.10.0", "1.11.0", "2.0.0"]
    df = spark.createDataFrame([(x,) for x in reversed(rising)], "v string")
    assert [r.v for r in df.orderBy(semver.version_order("v")).collect()] == rising


def test_bump(spark):
    pairs = [("1.0.0", "2.0.0"), ("1.0.0", "1.1.0"), ("1.0.0", "1.0.1"), ("0.1.0", "0.2.0"), ("0.0.1", "0.0.2"), ("0.1.0", "0.1.1"), ("x", "1.0.0"), (None, "1.0.0")]
    assert column(spark, pairs, semver.bump) == ["major", "minor", "patch", "major", "major", "patch", "major", "major"]


@pytest.mark.parametrize(
    "declared,yes,no",
    [
        ("^1.2.3", ["1.2.3", "1.9.0"], ["1.2.2", "2.0.0", "2.0.0-rc.1"]),
        ("^0.2.3", ["0.2.3", "0.2.9"], ["0.3.0"]),
        ("^0.0.3", ["0.0.3"], ["0.0.4"]),
        ("~1.2", ["1.2.0", "1.2.9"], ["1.3.0"]),
        ("1.x", ["1.0.0", "1.9.9"], ["2.0.0", "0.9.0"]),
        (">=1.2.0 <2", ["1.2.0", "1.99.0"], ["2.0.0", "1.1.9"]),
        ("1.2.3 - 2.3", ["1.2.3", "2.3.9"], ["2.4.0"]),
        ("<=1.2", ["1.2.9", "0.1.0"], ["1.3.0"]),
        (">1", ["2.0.0"], ["1.9.9"]),
        ("1.0.0 || ^3", ["1.0.0", "3.1.0"], ["1.0.1", "2.0.0"]),
        ("*", ["9.9.9"], []),
    ],
)
def test_ranges(spark, declared, yes, no):
    found = column(spark, [(v, declared) for v in yes + no], semver.satisfies)
    assert found == [True] * len(yes) + [False] * len(no)


def test_unreadable_ranges_are_null(spark):
    assert column(spark, [("1.0.0", "next"), ("x", "^1"), ("1.0.0", None)], semver.satisfies) == [None, None, None]


def test_specs_and_paths(spark):
    kinds = {"workspace:*": "workspace", "link:../x": "link", "file:./x": "file", "npm:a@1": "alias", "git+ssh://x/y.git": "git", "owner/name": "git", "https://x/y.tgz": "url", "^1.2.0": "range", "latest": "tag"}
    assert column(spark, list(kinds), paths.spec_kind) == list(kinds.values())
    assert column(spark, ["@a/b@1", "a@2", "a"], paths.spec_name) == ["@a/b", "a", "a"]
    assert column(spark, ["@a/b/c", "a/b", "./x"], paths.package_of) == ["@a/b", "a", None]
    assert column(spark, ["p/sub:a.b#c", "p:a"], paths.ancestors) == [["p/sub:a", "p/sub:a.b"], []]
    keys = ["git+https://github.com/Own/Name.git", "git@github.com:own/name.git", "github:own/name", "own/name", "https://github.com/own/name#readme"]
    assert column(spark, keys, paths.repository_key) == ["github.com/own/name"] * 5


def test_text(spark):
    assert column(spark, ["useThing", "email", "x1", "longlonglonglong"], T.is_code_shaped) == [True, False, True, True]
    assert column(spark, ["a  <!-- x --> [b](c) ![i](j) https://github.com/o/r/pull/12 <p>t</p> https://x.y"], lambda c: T.cleaned(T.prepared(c))) == ["a b #12 t"]
    assert column(spark, ["  const a = 'x' ;", 'const a="x"'], T.layout_free)[0] == column(spark, ['const a="x"'], T.layout_free)[0]
    assert column(spark, ["Short. Then a longer sentence ends here. More.", "x" * 300, "[Label](u) says that it works well! yes"], T.first_sentence) == ["Short. Then a longer sentence ends here.", "x" * 160, "Label says that it works well!"]
    assert column(spark, ["**New** `x` ⚠️ Thing", "A  b"], T.normalized_title) == ["new x thing", "a b"]
    assert column(spark, ["x_", "  // c", "<!-- x", "});", "$"], T.is_meaningful) == [True, False, False, False, True]
    assert column(spark, [1_000, 3_600_000, 172_800_000], numbers.age, "long") == ["1m ago", "1h ago", "2d ago"]
    assert column(spark, ["import x from 'a/b'", "require(\"a\")", "import('ab')"], lambda c: T.imports_package(c, F.lit("a"))) == [True, True, False]


def test_mentions_hold_to_patterns(spark):
    texts = ["call parse( now", "we parse text", "use obj.parse today", "useThing here", "notuseThing", "a.md and md", "<Email> tag", None]
    regions = spark.createDataFrame([(i, 0, "prose", t) for i, t in enumerate(texts)], "entry int, ord int, kind string, text string")
    names = spark.createDataFrame([("parse", "strong"), ("useThing", "strong"), ("md", "weak"), ("Email", "strong")], "name string, strength string")
    found = {(r.entry, r.name) for r in matching.mentions(regions, names).collect()}
    assert found == {(0, "parse"), (2, "parse"), (3, "useThing"), (5, "md"), (6, "Email")}


def test_nothing_is_dropped_from_buckets(spark):
    entries = spark.createDataFrame([(1, "change", False, "none"), (2, "change", True, "text"), (3, "change", True, "headline"), (4, "housekeeping", False, "none"), (5, "addition", False, "none"), (6, "change", False, "text")], "entry int, kind string, breaking boolean, names_api string")
    hits = spark.createDataFrame([(6, "a", "strong", "prose")], "entry int, name string, strength string, region string")
    found = {r.entry: (r.bucket, r.direct) for r in matching.buckets(entries, hits).collect()}
    assert found == {1: ("unattributed-change", False), 2: ("unattributed-breaking", False), 3: ("none", False), 4: ("none", False), 5: ("none", False), 6: ("matched", True)}


def test_demotion(spark):
    regions = spark.createDataFrame([(i, 0, "code-block", "useThing()" if i < 3 else "x") for i in range(12)], "entry int, ord int, kind string, text string")
    names = spark.createDataFrame([("useThing", "strong")], "name string, strength string")
    found = matching.mentions(regions, names)
    assert [(r.name, r.n, r.total) for r in matching.demoted(found, regions).collect()] == [("useThing", 3, 12)]
    assert matching.demoted(found, regions, part=0.5).count() == 0


def test_candidates(spark):
    day = lambda d: f"2026-01-{d:02d} 00:00:00"
    rows = [("a", "1.1.0", day(1), False), ("a", "1.2.0", day(2), True), ("a", "1.3.0", day(30), False), ("a", "2.0.0", day(3), False), ("a", "1.4.0-rc.1", day(1), False), ("a", "1.0.5", None, False)]
    releases = spark.createDataFrame(rows, "pkg string, version string, t string, deprecated boolean").select("pkg", "version", F.col("t").cast("timestamp").alias("published_at"), "deprecated")
    installed = spark.createDataFrame([("a", "1.0.0"), ("b", "1.0.0")], "pkg string, version string")
    latest = spark.createDataFrame([("a", "2.0.0")], "pkg string, latest string")
    found = {r.pkg: r for r in versions.candidates(installed, releases, latest, F.lit("2026-01-31").cast("timestamp"), 7).collect()}
    assert (found["a"].target, found["a"].bump, found["a"].also) == ("1.1.0", "minor", "2.0.0")
    assert [tuple(x) for x in found["a"].held_back] == [("1.3.0", "too-new"), ("1.2.0", "deprecated")]
    assert found["b"].target is None


def test_snapshots(spark):
    kind = "name string, manifest string, key string, version string"
    base = spark.createDataFrame([("a", "m", "k", "1.10.0"), ("a", "m", "k", "1.9.0"), ("b", "m", "k", "1.0.0")], kind)
    now = spark.createDataFrame([("a", "m", "k", "2.0.0"), ("b", "m", "k", "1.0.0"), ("c", "m", "k", "1.0.0")], kind)
    assert {(r.name, r.before, r.state) for r in versions.plan(now, base).collect()} == {("a", "1.9.0", "changed"), ("b", "1.0.0", "unchanged"), ("c", None, "added")}


def symbols(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "pkg string, path string, kind string, sig array<string>, deprecated boolean, alias_of string")


def test_surfaces(spark):
    a = symbols(spark, [("p:A", "class", [], False, None), ("p:A#x", "method", ["()"], False, None), ("p:f", "function", ["(a)"], False, None), ("p:g", "function", ["(a)"], False, None), ("p:h", "function", ["(a)"], False, None), ("p/v2:f", "function", ["(a)"], False, None)])
    b = symbols(spark, [("p:f", "function", ["(b)"], False, None), ("p/v2:f", "function", ["(b)"], False, None), ("p:g", "function", ["(b)", "(a)"], False, None), ("p:h", "function", ["(a)"], True, None), ("p:new", "function", [], False, None)])
    changes = surfaces.without_children(surfaces.diff(a, b))
    found = {(r.path, r.bucket, tuple(r.also_at)) for r in surfaces.collapsed(changes).collect()}
    assert found == {("p:A", "removed", ()), ("p:f", "changed", ("p/v2:f",)), ("p:g", "widened", ()), ("p:h", "deprecated", ()), ("p:new", "added", ())}
    refs = spark.createDataFrame([("p", "p:A#x", None), ("p", "p:f", None), ("p", "p:z#h", "h")], "pkg string, ref string, weak_name string")
    landed = {(r.path, r.ref, r.strength) for r in surfaces.touched(refs, changes).collect()}
    assert landed == {("p:A", "p:A#x", "strong"), ("p:f", "p:f", "strong")}  # a function is no member, so its name alone says nothing
    members = surfaces.diff(symbols(spark, [("p:B#m", "method", ["()"], False, None)]), symbols(spark, []))
    assert {(r.ref, r.strength) for r in surfaces.touched(spark.createDataFrame([("p", "p:x", "m")], "pkg string, ref string, weak_name string"), members).collect()} == {("p:x", "weak")}


def test_aliases(spark):
    rows = [("p:a", "function", ["own"], False, "p:b"), ("p:b", "function", ["mid"], False, "p:c"), ("p:c", "function", ["end"], False, None), ("p:d", "function", ["self"], False, "p:gone")]
    assert {r.path: r.sig for r in surfaces.dereferenced(symbols(spark, rows)).collect()} == {"p:a": ["end"], "p:b": ["end"], "p:c": ["end"], "p:d": ["self"]}


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src int, dst int")
    roots = spark.createDataFrame([(1,), (9,)], "root int")
    seen, cut = graphs.closure(edges, roots, 5)
    assert {(r.root, r.node, r.depth) for r in seen.collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (9, 9, 0)} and not cut
    seen, cut = graphs.closure(edges, roots, 2)
    assert seen.count() == 4 and cut


def test_followups_span_slots(spark):
    rows = [(1, 1, "2026-01-01"), (1, 2, "2026-01-14"), (1, 3, "2026-01-15"), (1, 4, "2026-02-20"), (2, 5, "2026-01-02")]
    df = spark.createDataFrame(rows, "k int, id int, d string").select("k", "id", F.col("d").cast("timestamp").alias("at"))
    found = lines.followups(df.filter("id = 1"), df.filter("id > 1"), "k")
    assert [(r.next_id, r["rank"]) for r in found.collect()] == [(2, 1)]


def test_verdicts(spark):
    counts = ["removed", "changed", "deprecated", "weak", "matched", "unattributed_breaking", "unattributed_change", "blind", "opaque", "refs", "flagged", "out_of_sync"]
    base = dict.fromkeys(counts, 0) | {"refs": 1, "surface": "computed", "notes": "complete", "bump": "minor", "incomplete": False}
    cases = [base, base | {"removed": 1}, base | {"removed": 1, "surface": "failed"}, base | {"refs": 0}, base | {"notes": "partial"}, base | {"bump": "major", "weak": 1}, base | {"matched": None}, base | {"incomplete": None}]
    schema = "i int, " + ", ".join(f"{c} int" for c in counts) + ", surface string, notes string, bump string, incomplete boolean"
    df = spark.createDataFrame([(i, *[c[k] for k in counts], c["surface"], c["notes"], c["bump"], c["incomplete"]) for i, c in enumerate(cases)], schema)
    found = {r.i: (r.verdict, r.reasons) for r in verdicts.decide(df).collect()}
    assert found[0] == ("quiet", ["notes-complete-no-match", "surface-clean"])
    assert found[1] == ("blocked", ["removed-touched"])
    assert found[2][0] == "review" and "surface-incomplete" in found[2][1]
    assert found[3] == ("review", ["not-referenced"])
    assert found[4] == ("quiet", ["surface-clean", "caveat-no-notes"])
    assert found[5][1] == ["possibly-touched", "major-unproven"]
    assert found[7] == ("review", ["surface-incomplete"])
    assert found[6][0] == "review"  # what can't be judged is never quiet
