"""Surfaces compared name by name and signature by signature, and briefs in the order in which they are read."""

import pytest
from pyspark.sql import functions as F

from shiftscope.functions import signatures
from shiftscope.operators import briefs, history, matching, surfaces, verdicts


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


SYMBOLS = "pkg string, path string, kind string, sig array<string>, deprecated boolean, alias_of string, unresolved_base boolean"


def symbols(spark, *rows):
    return frame(spark, SYMBOLS, *[("p", path, kind, list(sig), old, alias, base) for path, kind, sig, old, alias, base in rows])


def s(path, kind="function", sig=("() => R",), old=False, alias=None, base=False):
    return path, kind, sig, old, alias, base


TYPES = {
    "{ size?: number | Grid<Q> | undefined; on?: undefined | string; }": "{ size?: Grid<Q> | number | undefined; on?: string | undefined }", "Map<number, Set<q | p>>": "Map<number, Set<p | q>>",
    "H<Z | Y, X | W>": "H<Y | Z, W | X>", "(event: E) => void | null": "(event: E) => void | null", '"south" | "north" | "west"': '"north" | "south" | "west"', 'import("./types").Panel': "Panel",
    "Dict<string, lib.inner.Blob>": "Dict<string, Blob>", '"x.y" | 2.5': '"x.y" | 2.5', "m | n & o": "m | n & o", "(": "(", "": "",
}


def test_types_in_one_spelling(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TYPES, None])], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(signatures.normalized_type(F.col("t"))).collect()] == [*TYPES.values(), None]
    long = signatures.type_text(" | ".join(f"t{i}" for i in range(2000)))
    assert long.startswith("#") and len(long) == 41
    assert signatures.type_text("[" * 50_000) == f"#{__import__('hashlib').sha1(('[' * 50_000).encode()).hexdigest()}"


def test_signature_text(spark):
    kind = "tp array<struct<name:string,extends:string>>, ps array<struct<type:string,rest:boolean,optional:boolean>>, r string"
    rows = [([("T", None)], [("T", False, False)], "T"), ([("U", "A<U>")], [("U", False, False), ("Map<U, V>", True, False), ("string", False, True)], "U[]"), ([], [], "void")]
    found = [r[0] for r in frame(spark, kind, *rows).select(signatures.signature(F.col("tp"), F.col("ps"), F.col("r"))).collect()]
    assert found == ["<$T0>($T0) => $T0", "<$T0 extends A<$T0>>($T0, ...Map<$T0, V>, string?) => $T0[]", "() => void"]


@pytest.mark.parametrize(
    "before,after,widened,first",
    [
        (["(a) => R"], ["(a) => R", "(b) => R"], True, None),
        (["(a) => R"], ["(a, b?) => R"], True, None),
        (["(a) => R"], ["(a, ...b) => R"], True, None),
        (["(a) => R"], ["(a, b) => R"], False, None),
        (["(a, b?) => R"], ["(a, c?) => R"], False, 1),
        (["(a, b?, c?) => R"], ["(a, b?, d?) => R"], False, 2),
        (["(a, b) => R"], ["(a, c) => R"], False, None),
        (["(a?) => R", "(x, y?) => R"], ["(b?) => R", "(x, z?) => R"], False, 0),
        (["(a<b, c>?, d?) => R"], ["(a<b, c>?, e?) => R"], False, 1),
        (["(a?) => R"], ["(a?) => S"], False, None),
        (["<T>(a?) => R"], ["<U>(b?) => R"], False, None),
        ([], ["(a) => R"], False, None),
        (["#hash"], ["#other"], False, None),
        (["(A?) => (C?) => D"], ["(A?) => (E?) => D"], False, None),  # what it gives differs
        (["(A?) => (C?) => D"], ["(B?) => (C?) => D"], False, 0),
        (["(A, (x: B?) => C?) => D"], ["(A, (x: E?) => C?) => D"], False, 1),
        (["(A, { f: (C?) => D }?) => R"], ["(A, { f: (E?) => D }?) => R"], False, 1),
        (["{ x: (C?) => D }"], ["{ x: (E?) => D }"], False, None),
        (["() => { x: (C?) => D }"], ["() => { x: (E?) => D }"], False, None),
        (["<$T0 extends (a) => b>($T0, 'a,)'?) => R"], ["<$T0 extends (a) => b>($T0, 'b,)'?) => R"], False, 1),
    ],
)
def test_parameters(spark, before, after, widened, first):
    df = frame(spark, "a array<string>, b array<string>", (before, after))
    assert tuple(df.select(signatures.is_widening(F.col("a"), F.col("b")), signatures.first_changed_parameter(F.col("a"), F.col("b"))).first()) == (widened, first)


def test_any_covers(spark):
    pairs = [(["(any) => R"], ["(Foo<x>) => R"], True), (["(a) => any"], ["(a) => B | C"], True), (["(many) => R"], ["(x) => R"], False), (["(any) => R"], ["(a) => S"], False), ([], [], False), (["x"], ["x", "y"], False)]
    df = frame(spark, "a array<string>, b array<string>", *[p[:2] for p in pairs])
    assert [r[0] for r in df.select(signatures.same_modulo_any(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_moved_names(spark):
    before = symbols(spark, s("p:default", "class"), s("p:default.Server"), s("p:Server", alias="p:default.Server"), s("p:z.object"), s("p:z", "namespace"), s("p:gone"))
    after = symbols(spark, s("p:Server"), s("p:default", "namespace"), s("p:z", "namespace", alias="p:default"), s("p:default.object"))
    assert {(r.path, r.found) for r in surfaces.moved(before, after).collect()} == {("p:default", "p:default"), ("p:default.Server", "p:Server"), ("p:Server", "p:Server"), ("p:z", "p:z"), ("p:z.object", "p:default.object")}
    told = {(r.path, r.bucket) for r in surfaces.diff(before, after).collect()}
    assert ("p:gone", "removed") in told and not {p for p, b in told if b == "removed"} - {"p:gone"}


def test_unproven_removals(spark):
    before = symbols(spark, s("p:A", "class"), s("p:A#x"), s("p:B"), s("p/v2:C"), s("p/v3:D"))
    after = symbols(spark, s("p:A", "class", base=True))
    entries = frame(spark, "pkg string, prefix string, external array<string>", ("p", "p", []), ("p", "p/v2", ["other"]))
    flags = lambda *x: frame(spark, "pkg string, flag string", *[("p", f) for f in x])
    causes = lambda found: {r.path: (r.bucket, r.cause) for r in found.collect() if r.bucket in ("removed", "unproven")}
    assert causes(surfaces.diff(before, after, entries)) == {"p:A#x": ("unproven", "unresolved-base"), "p:B": ("removed", None), "p/v2:C": ("unproven", "external-reexport"), "p/v3:D": ("removed", None)}
    assert causes(surfaces.diff(before, after, entries, flags("wildcard-truncated")))["p/v3:D"] == ("unproven", "subpath-cap")
    assert {b for b, _ in causes(surfaces.diff(before, after, entries, flags("symbol-cap"))).values()} == {"unproven"}


def test_lenient_and_parameters(spark):
    before = symbols(spark, s("p:f", sig=["(any) => R"]), s("p:g", sig=["(a, b?) => R"]))
    after = symbols(spark, s("p:f", sig=["(Foo) => R"]), s("p:g", sig=["(a, c?) => R"]))
    told = lambda **k: {r.path: (r.bucket, r.from_param) for r in surfaces.diff(before, after, **k).collect()}
    assert told() == {"p:f": ("changed", None), "p:g": ("changed", 1)} and told(lenient=True) == {"p:g": ("changed", 1)}
    refs = frame(spark, "pkg string, ref string, weak_name string, args int", ("p", "p:g", None, 1), ("p", "p:f", None, 1), ("p", "p:g", None, 2), ("p", "p:z", "g", None))
    landed = {(r.path, r.ref, r.strength) for r in surfaces.touched(refs, surfaces.collapsed(surfaces.diff(before, after))).collect()}
    assert landed == {("p:f", "p:f", "strong"), ("p:g", "p:g", "strong")}  # by the call with two arguments; g is no member
    one = refs.filter("args = 1 or args is null")
    assert {r.ref for r in surfaces.touched(one, surfaces.collapsed(surfaces.diff(before, after))).collect()} == {"p:f"}


def test_surfaces_with_and_without_aliases_elsewhere(spark):
    """What nothing is aliased in is compared in one join, and comes out as beside a package with aliases."""
    import random

    rnd = random.Random(12)
    kinds, sigs = ["function", "namespace", "interface", "class"], [[], ["() => A"], ["(x) => A"], ["(x, y?) => A"], ["(x?) => A", "() => A"]]
    side = lambda: {f"p:n{k}": s(f"p:n{k}", rnd.choice(kinds), rnd.choice(sigs), rnd.random() < 0.3) for k in rnd.sample(range(60), 45)}
    before, after = side(), side()
    a, b = symbols(spark, *before.values()).drop("unresolved_base"), symbols(spark, *after.values()).drop("unresolved_base")
    other = symbols(spark, s("z:x"), s("z:y", alias="z:x")).drop("unresolved_base").withColumn("pkg", F.lit("z"))
    rows = lambda df: sorted(map(str, df.filter("pkg = 'p'").collect()))
    plain = surfaces.diff(a, b)
    assert rows(plain) == rows(surfaces.diff(a.unionByName(other), b.unionByName(other)).select(plain.columns))
    assert {r.bucket for r in plain.collect()} == {"removed", "added", "changed", "widened", "deprecated"}


def test_subjects(spark):
    records = frame(spark, "entry string, version string, subjects array<string>", ("e", "1", ["p:A{strict}", "p:A", "p:none", "p:A{no}", "p:B{strict}"]), ("x", "1", ["p:A"]))
    entries = frame(spark, "id string, version string", ("e", "1"), ("x", "2"))
    table = frame(spark, "side string, path string, options array<string>, alias_of string", ("from", "p:A", ["strict"], None), ("to", "p:B", [], "p:A"), ("from", "p:B", [], "p:A"))
    (kept,) = matching.provable(records, entries, table).collect()
    assert kept.subjects == ["p:A", "p:A{strict}", "p:B{strict}"]
    assert matching.provable(records, entries).first().subjects == sorted(["p:A{strict}", "p:A", "p:none", "p:A{no}", "p:B{strict}"])
    reached = frame(spark, "path string, site string", ("p:A#x", "f:1"), ("p:A", "f:2"), ("p:AB", "f:3"))
    hits = matching.subject_hits(records.filter("entry = 'e'"), reached)
    assert {(r.name, r.subject, r.site) for r in hits.collect()} == {(n, x, site) for n, x in (("strict", "p:A{strict}"), ("A", "p:A"), ("no", "p:A{no}")) for site in ("f:1", "f:2")}


def test_removals_tied(spark):
    notes = frame(spark, "entry string, regions array<struct<kind:string,text:string>>", ("n", [("title", "Remove deprecated namespace support")]), ("d", [("title", "Drop all Deprecated things")]), ("o", [("title", "Other"), ("code-block", "namespace x")]))
    removed = frame(spark, "path string, namespace boolean, was_deprecated boolean", ("p:ns.a", True, True), ("p:old", False, True), ("p:new", False, False))
    assert {(r.entry, r.name, r.subject) for r in matching.removals_tied(notes, removed).collect()} == {("n", "a", "p:ns.a"), ("d", "a", "p:ns.a"), ("d", "old", "p:old")}


REFS = "pkg string, file string, line int, type_only boolean, strong array<string>, weak array<string>"


def test_usage(spark):
    refs = frame(spark, REFS, ("p", "a", 2, True, ["f"], ["g"]), ("p", "a", 2, False, ["f"], []), ("p", "b", 1, False, ["g"], ["h"]), ("q", "c", 1, False, [], []))
    told = {r.pkg: (r.strong_names, r.weak_names, r.files, r.refs) for r in briefs.name_sets(refs).collect()}
    assert told == {"p": (["f", "g"], ["h"], 2, 3), "q": ([], [], 1, 1)}
    options = frame(spark, "pkg string, name string, file string, line int, type_only boolean", ("p", "h", "z", 9, False), ("p", "opt", "z", 9, False))
    assert {(r.name, r.file, r.line, r.type_only, r.place) for r in briefs.sites_by_name(refs, options).collect()} == {("f", "a", 2, False, 1), ("g", "a", 2, True, 1), ("g", "b", 1, False, 2), ("h", "b", 1, False, 1), ("opt", "z", 9, False, 1)}
    chains = frame(spark, "c array<struct<name:string,call:boolean>>, called boolean, derived boolean", ([("a", False), ("b", True), ("c", False)], False, False), ([("a", False)], True, False), ([("a", True)], False, True), ([], False, False))
    assert [(r.x.strong, r.x.weak) for r in chains.select(briefs.chain_names(F.col("c"), F.col("called"), F.col("derived")).alias("x")).collect()] == [(["a", "b"], ["c"]), ([], ["a"]), ([], ["a"]), ([], [])]


def test_types_are_used_as_what_they_type(spark):
    kind = "pkg string, refs long, files long, strong_names array<string>, weak_names array<string>, opaque array<string>, blind array<string>"
    usage = frame(spark, kind, ("react", 2, 1, ["b", "a"], [], ["x"], []), ("node:fs", 1, 1, ["readFile"], [], [], []), ("@types/react", 1, 1, ["own"], [], ["o"], []))
    installed = frame(spark, "pkg string", ("react",), ("@types/react",), ("@types/node",), ("@types/gone",))
    told = {r.pkg: (r.refs, r.strong_names, r.opaque) for r in briefs.with_types(usage, installed).collect()}
    assert told == {"react": (2, ["b", "a"], ["x"]), "node:fs": (1, ["readFile"], []), "@types/react": (2, ["a", "b"], ["o"]), "@types/node": (1, ["readFile"], []), "@types/gone": (0, [], ["ambient-types"])}
    opaque = frame(spark, "pkg string, kind string", ("react", "config-reference"), ("react", "css"), ("tool", "config-reference"))
    told = {r.pkg: (r.refs, r.opaque) for r in briefs.with_opaque(usage.filter("pkg = 'react'"), opaque).collect()}
    assert told == {"react": (2, ["x", "css"]), "tool": (0, ["config-reference"])}


def test_groups_and_requests(spark):
    packages = frame(spark, "pkg string, verdict string, reasons array<string>", ("b", "review", ["opaque-usage"]), ("a", "review", ["notes-match"]), ("z", "blocked", ["removed-touched"]), ("q", "quiet", ["caveat-no-types"]), ("n", "review", ["no-evidence"]))
    assert {(r.pkg, r.shown, r.place) for r in briefs.groups(packages).collect()} == {("z", "detailed", 1), ("a", "detailed", 2), ("n", "detailed", 3), ("q", "quiet", 1), ("b", "unseen", 1)}
    assert [r[0] for r in packages.orderBy("pkg").select(briefs.is_one_net(F.col("reasons"))).collect()] == [False, False, False, True, False]
    installed, declared = frame(spark, "pkg string", ("real",), ("b",)), frame(spark, "pkg string, key string", ("real", "alias"), ("b", "b"))
    wanted = frame(spark, "name string, local boolean", ("alias", False), ("nope", False), ("mine", True))
    kept, missing = briefs.requested(installed, declared, wanted)
    assert [r.pkg for r in kept.collect()] == ["real"]
    assert {tuple(r) for r in missing.collect()} == {("nope", "not-declared"), ("mine", "local")}


def test_findings(spark):
    touched = frame(spark, "pkg string, path string, bucket string, strength string, ord int", ("p", "p:w", "removed", "weak", 0), ("p", "p:r", "removed", "strong", 1), ("p", "p:c", "changed", "strong", 2))
    kind = "pkg string, entry string, bucket string, breaking boolean, direct boolean, hinted boolean, ord int"
    notes = frame(spark, kind, ("p", "fix", "matched", False, True, None, 0), ("p", "break", "matched", True, True, None, 1), ("p", "weakbreak", "matched", True, False, None, 2), ("p", "u1", "unattributed-change", False, False, False, 3), ("p", "u2", "unattributed-change", False, False, True, 4), ("p", "ub", "unattributed-breaking", True, False, None, 5), ("p", "no", "none", False, False, None, 6))
    assert [r.id for r in briefs.findings(touched, notes).orderBy("place").collect()] == ["p:r", "break", "p:c", "weakbreak", "fix", "ub", "p:w", "u2", "u1"]


def test_labels_and_limits(spark):
    hits = frame(spark, "h array<struct<name:string,option:boolean>>", ([("a", None), ("a", False), ("o", True)],), ([("o", True)],))
    assert [r[0] for r in hits.select(briefs.used_label(F.col("h"))).collect()] == ["names: a; options: o", "options: o"]
    per = frame(spark, "pkg string, version string, source string, reason string", ("p", "1.10.0", "releases", None), ("p", "1.9.0", "changelog", None), ("p", "1.11.0", None, "no-repo"))
    r = briefs.union_sources(per).first()
    assert (r.found, r.total, r.sources, r.reasons) == (2, 3, ["changelog", "releases"], ["no-repo"])
    label = frame(spark, "c string, f int, t int, s array<string>, r array<string>", ("partial", 2, 3, ["x"], []), ("unavailable", 0, 1, [], ["offline"]), ("disabled", 0, 0, [], []))
    assert [x[0] for x in label.select(briefs.coverage_label(F.col("c"), F.col("f"), F.col("t"), F.col("s"), F.col("r"))).collect()] == ["partial 2 of 3: x", "unavailable: offline", "disabled"]
    sites = frame(spark, "f string, l int, t boolean, v array<string>", ("a.ts", 3, True, ["x", "y"]), ("a.ts", 3, False, None))
    assert [x[0] for x in sites.select(briefs.site_label(F.col("f"), F.col("l"), F.col("t"), F.col("v"))).collect()] == ["a.ts:3 (type) through y", "a.ts:3"]
    packages = frame(spark, "weak_names array<string>, surface string, notes string, opaque array<string>", (["x"], "computed", "complete", []), ([], "no-types", "disabled", []))
    global_ = frame(spark, "kind string, count long", ("require-nonliteral", 2), ("dynamic-import-nonliteral", 1))
    found = [(r.code, r.line[:9]) for r in briefs.limits(packages, global_).orderBy("place").collect()]
    assert found == [("behaviour", "How code "), ("members-by-name", "Project c"), ("untyped", "Where a p"), ("computed-names", "3 imports"), ("out-of-scope", "Local nam")]
    assert briefs.limits(packages.filter("false"), global_).count() == 0


STATES = "i int, enabled boolean, refs int, missing boolean, has_types boolean, types_package boolean, offline boolean, failed boolean, elsewhere boolean, unproven int, cut boolean"


def test_states(spark):
    some = {"enabled": True, "refs": 1, "has_types": True}
    cases = [
        ({"enabled": False}, "disabled", False), (some | {"refs": 0}, "disabled", False), (some | {"missing": True, "offline": True, "has_types": False}, "failed", False), (some | {"has_types": False, "types_package": True}, "types-from-@types", False),
        (some | {"has_types": False}, "no-types", False), (some | {"offline": True, "failed": True}, "offline-uncached", False), (some | {"failed": True}, "failed", False), (some | {"has_types": None, "elsewhere": True, "unproven": 3}, "types-elsewhere", False),
        (some | {"unproven": 1}, "computed", True), (some | {"cut": True}, "computed", True), (some | {"unproven": 0, "cut": False}, "computed", False),
    ]
    names = [c.split()[0] for c in STATES.split(", ")][1:]
    rows = frame(spark, STATES, *[(i, *[case.get(c) for c in names]) for i, (case, *_) in enumerate(cases)])
    assert [(r.surface, r.incomplete) for r in briefs.surface_state(rows).orderBy("i").collect()] == [tuple(want) for _, *want in cases]


COUNTS = ["removed", "changed", "deprecated", "weak", "matched", "unattributed_breaking", "unattributed_change", "blind", "opaque", "refs", "flagged", "out_of_sync"]


def test_what_is_proven_removed_blocks_beside_what_is_not(spark):
    """One used removal and a name that can't be proven: blocked, and the doubt is told beside it."""
    base = {c: 0 for c in COUNTS} | {"refs": 2, "notes": "unavailable", "bump": "major", "enabled": True, "has_types": True, "unproven": 0}
    cases = [base | {"removed": 1, "unproven": 1}, base | {"unproven": 1}, base | {"removed": 1}, base | {"bump": "minor", "notes": "complete", "unproven": 2}, base | {"bump": "minor", "notes": "complete"}]
    names = list(base)
    rows = spark.createDataFrame([(i, *[c[n] for n in names]) for i, c in enumerate(cases)], ["i", *names])
    found = [(r.verdict, r.reasons) for r in verdicts.decide(briefs.surface_state(rows)).orderBy("i").collect()]
    assert found == [
        ("blocked", ["removed-touched", "surface-incomplete", "major-unproven"]), ("review", ["surface-incomplete", "major-unproven"]), ("blocked", ["removed-touched", "major-unproven"]),
        ("review", ["surface-incomplete"]), ("quiet", ["notes-complete-no-match", "surface-clean"]),
    ]


def test_what_is_unproven_is_counted_apart(spark):
    refs = frame(spark, "pkg string, ref string, weak_name string", ("p", "p:A#x", None), ("p", "p:B.y", None), ("p", None, "z"), ("p", "p:C", None))
    kind = "pkg string, path string, bucket string, cause string"
    changes = frame(spark, kind, ("p", "p:A", "unproven", "symbol-cap"), ("p", "p:B", "unproven", "unresolved-base"), ("p", "p:Q#z", "unproven", "symbol-cap"), ("p", "p:unused", "unproven", "symbol-cap"), ("p", "p:C", "removed", None))
    assert {(r.path, r.bucket) for r in surfaces.touched(refs, changes).collect()} == {("p:C", "removed")}
    assert {(r.cause, r.n) for r in surfaces.in_doubt(refs, changes).collect()} == {("symbol-cap", 2), ("unresolved-base", 1)}
    shown = frame(spark, "pkg string, path string, bucket string, strength string, ord int", ("p", "p:A", "unproven", "strong", 0), ("p", "p:C", "removed", "strong", 1))
    none = frame(spark, "pkg string, entry string, bucket string, breaking boolean, direct boolean, hinted boolean, ord int")
    assert [r.id for r in briefs.findings(shown, none).collect()] == ["p:C"]


def test_corpus(spark):
    expected = frame(spark, "id int, file string, line int, text string, packages array<string>", (1, "a", 3, "use(thing)", ["p", "q"]), (1, "b", 1, "x", ["p"]), (2, "a", 1, "y", ["p"]))
    added = frame(spark, "id int, file string, text string", (1, "a", "call(other)"), (1, "z", "nothere()"))
    facts = frame(spark, "id int, package string, kind string, file string, line int, name string", (1, "p", "site", "a", 3, None), (1, "p", "name", None, None, "other"), (1, "p", "name", None, None, "nothere"), (1, "q", "import", "b", 1, None), (2, "p", "option", "c", 1, None))
    found = history.evidence(expected, added, facts)
    assert {(r.id, r.package, tuple(r.on_site), tuple(r.imports), tuple(r.names)) for r in found.collect()} == {(1, "p", ("a:3",), (), ("other",))}
    lines_ = frame(spark, "id int, file string, line int, text string, packages array<string>", (1, "a", 1, "foo-bar(x.y)", ["p"]), (1, "a", 2, "myfoo-bar é", ["p"]))
    said = frame(spark, "id int, package string, kind string, file string, line int, name string", *[(1, "p", "name", None, None, n) for n in ("foo-bar", "x.y", "foo", "oo-bar", "bar(x", "é", "y", "gone-bar")])
    assert [r.names for r in history.evidence(lines_, added.filter("false"), said).collect()] == [sorted(["foo-bar", "x.y", "foo", "bar(x", "é", "y"])]
    cases = frame(spark, "id int, layout_share double", (1, 0.2), (2, 0.0), (3, 0.5))
    checked = history.checked(cases, found)
    assert {r.id: r.check for r in checked.collect()} == {1: "supported", 2: "weak", 3: "reformat"}
    assert [r.id for r in history.counted(checked).collect()] == [1]
    rows = frame(spark, "repo string, verdict string, adapted array<string>, follow_ups array<string>", ("r", "quiet", ["a"], []), ("r", "quiet", [], []), ("r", "not-analysed", [], ["x"]))
    r = history.histogram(rows).first()
    assert (r.upgrades, r.quiet, r.not_analysed, r.adapted, r.suspects) == (3, 2, 1, 2, 1)
    people = frame(spark, "a string, e string, l string", ("Renovate Bot", "x", None), ("Jo", "49+renovate[bot]@users", None), ("bot fan", "jo@x", "jo"), ("x", "bot@corp.io", None))
    assert [x[0] for x in people.select(history.is_bot(F.col("a"), F.col("e"), F.col("l"))).collect()] == [True, True, False, True]
    quoted = frame(spark, "p string", ('"a\\303\\251\\tb.ts"',), ("plain.ts",), ('"q\\"x"',))
    assert [x[0] for x in quoted.select(history.unquoted(F.col("p"))).collect()] == ["aé\tb.ts", "plain.ts", 'q"x']
    titles = frame(spark, "t string", ("chore: update all non-major",), ("bump x",), ("Lock file maintenance",))
    assert [x[0] for x in titles.select(history.is_grouped(F.col("t"))).collect()] == [True, False, True]
    tests = frame(spark, "p string", ("src/a.test.ts",), ("tests/x.js",), ("src/latest/x.ts",), ("vitest.config.ts",))
    assert [x[0] for x in tests.select(history.is_test_path(F.col("p"))).collect()] == [True, True, False, True]
