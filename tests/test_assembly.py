"""A brief from its tables to its document: what each stage hands on, and that the JSON says what the tables say."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import assembly, chains, usage, verdicts
from shiftscope.sources import records

SYMBOLS = "pkg string, version string, path string, kind string, sig array<string>, deprecated boolean, alias_of string, returns string, instance_of string"
REFS = f"pkg string, file string, line int, col int, type_only boolean, code string, via string, way string, hops int, prefix string, binding string, imported string, called boolean, chain array<{chains.SEGMENT}>, built array<{chains.SEGMENT}>, built_called boolean, blind string"


def now():
    return F.lit("2026-01-01").cast("timestamp")


def ref(pkg, file, line, imported, *names, called=False, type_only=False, blind=None, via=None, args=None):
    chain = [(n, k < len(names) - 1, False, args if k == 0 else None) for k, n in enumerate(names)]
    return pkg, file, line, 1, type_only, f"{imported}(...)", via, "direct" if via is None else "forwarded", 0, pkg, "named", imported, called, chain, None, None, blind


@pytest.fixture(scope="module")
def project(spark):
    at = datetime.datetime(2025, 6, 1)
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    releases = [("ring", v, at, False) for v in ("1.0.0", "1.1.0", "1.2.0", "2.0.0")] + [("calm", v, at, False) for v in ("1.0.0", "1.0.1")] + [("bare", v, at, False) for v in ("0.1.0", "0.1.1")] + [("idle", "1.0.0", at, False)] + [("lost", "3.1.0", at, False)]
    symbols = [
        *[("ring", v, "ring:make", "function", [f"({'A' if v == '1.0.0' else 'B'}) => Ring"], False, None, "ring:Ring", None) for v in ("1.0.0", "1.2.0")],
        *[("ring", v, "ring:Ring", "class", [], False, None, None, "ring:Ring") for v in ("1.0.0", "1.2.0")],
        ("ring", "1.0.0", "ring:Ring#tail", "method", ["() => A"], False, None, None, None),
        *[("ring", v, "ring:Ring#size", "property", ["number"], v == "1.2.0", None, None, None) for v in ("1.0.0", "1.2.0")],
        *[("calm", v, "calm:still", "function", ["() => A"], False, None, None, None) for v in ("1.0.0", "1.0.1")],
    ]
    return assembly.Project(
        frame("pkg string, version string, version_source string, manifests array<string>, flags array<string>, out_of_sync int", *[(p, v, "lockfile", ["package.json", "a/package.json"], [], 0) for p, v in (("ring", "1.0.0"), ("calm", "1.0.0"), ("bare", "0.1.0"), ("idle", "1.0.0"), ("lost", "3.0.0"))]),
        frame("pkg string, version string, published_at timestamp, deprecated boolean", *releases),
        frame("pkg string, latest string", ("ring", "2.0.0"), ("calm", "1.0.1"), ("bare", "0.1.1"), ("idle", "1.0.0"), ("lost", "3.1.0")),
        frame(SYMBOLS, *symbols),
        frame("pkg string, version string, prefix string, external array<string>", *[(p, v, p, []) for p, v in (("ring", "1.0.0"), ("ring", "1.2.0"), ("calm", "1.0.0"), ("calm", "1.0.1"))]),
        frame(REFS, ref("ring", "a.ts", 3, "make", "tail", called=True), ref("ring", "a.ts", 3, "make", "tail", called=True, type_only=True), ref("ring", "b.ts", 9, "make", "size", called=True, via="proxy.ts"), ref("calm", "a.ts", 5, "still"), ref("bare", "c.ts", 1, "thing"), ref("ring", "z.ts", 1, "make", blind="namespace-escape"), ref("lost", "l.ts", 2, "x")),
        frame("pkg string, kind string", ("bare", "css-import")),
        [("releases", frame("pkg string, version string, body string, reason string", ("ring", "1.1.0", "- Rings keep `tail()` alive (#4)\n- chore: sort", None), ("ring", "1.2.0", "- BREAKING CHANGE: old engines are out\n- Something else moved", None), ("calm", "1.0.1", "- docs: a better guide", None), ("bare", "0.1.1", None, "no-repo"), ("lost", "3.1.0", "- chore: x", None)))],
    )


@pytest.fixture(scope="module")
def found(project):
    return assembly.documents(assembly.stages(project, now(), 7))


@pytest.fixture(scope="module")
def documents(found):
    return {r.pkg: json.loads(r.json) for r in found.select("pkg", F.to_json("document").alias("json")).collect()}


def test_verdicts(documents):
    assert set(documents) == {"ring", "calm", "bare", "lost"}  # idle is up to date
    codes = {p: (d["verdict"], [r["code"] for r in d["reasons"]]) for p, d in documents.items()}
    assert codes == {
        "ring": ("blocked", ["removed-touched", "changed-touched", "deprecated-touched", "notes-match", "unattributed-breaking", "unattributed-change", "blind-spots"]),
        "calm": ("quiet", ["notes-complete-no-match", "surface-clean"]),
        "bare": ("review", ["opaque-usage", "no-evidence"]),
        "lost": ("review", ["flagged-install", "surface-incomplete"]),
    }


def test_a_document_in_full(documents):
    site = lambda file, line, code="make(...)", **more: {"file": file, "line": line, "column": 1, "typeOnly": False, "code": code, **more}
    a, b = site("a.ts", 3), site("b.ts", 9, via=["proxy.ts"])
    ring = documents["ring"]
    assert ring["types"] == {
        "status": "computed", "changes": 3, "added": 0,
        "touched": [
            {"path": "ring:Ring#tail", "alsoAt": [], "change": "removed", "certainty": "exact", "before": ["() => A"], "sites": [a]},
            {"path": "ring:make", "alsoAt": [], "change": "changed", "certainty": "exact", "before": ["(A) => Ring"], "after": ["(B) => Ring"], "sites": [a, b]},
            {"path": "ring:Ring#size", "alsoAt": [], "change": "deprecated", "certainty": "exact", "before": ["number"], "after": ["number"], "sites": [b]},
        ],
    }
    assert ring["notes"] == {
        "coverage": "complete", "entries": 3, "versions": [{"version": v, "status": "found", "source": {"kind": "releases"}} for v in ("1.1.0", "1.2.0")],
        "matched": [{"version": "1.1.0", "title": "Rings keep tail() alive (#4)", "breaking": False, "direct": False, "refs": ["#4"], "names": [{"name": "tail", "certainty": "by-name", "where": "inline-code"}]}],
        "breakingWithoutApi": [{"version": "1.2.0", "title": "BREAKING CHANGE: old engines are out", "refs": []}], "changesWithoutApi": [{"version": "1.2.0", "title": "Something else moved", "refs": []}],
    }
    assert ring["usage"] == {"files": 2, "sites": 3, "names": {"exact": ["make"], "byName": ["size", "tail"]}, "sitesByName": {"make": [a, b], "size": [b], "tail": [a]}, "cannotSee": [{"kind": "namespace-escape", "count": 1}]}
    assert {k: ring[k] for k in ("name", "from", "to", "bump", "publishedAt", "versionSource", "manifests")} == {"name": "ring", "from": "1.0.0", "to": "1.2.0", "bump": "minor", "publishedAt": "2025-06-01T00:00:00Z", "versionSource": "lockfile", "manifests": ["a/package.json", "package.json"]}
    assert ring["alsoAvailable"] == {"version": "2.0.0", "bump": "major"} and "alsoAvailable" not in documents["calm"]


#: The contract: names of fields, in brackets those that may be absent; a list's items behind it.
SHAPE = {
    "name": str, "from": str, "to": str, "bump": str, "publishedAt": str, "verdict": str, "reasons": [{"code": str, "detail": str}], "versionSource": str, "manifests": [str],
    "types": {"status": str, "(detail)": str, "(changes)": int, "(added)": int, "touched": [{"path": str, "alsoAt": [str], "change": str, "certainty": str, "(before)": [str], "(after)": [str], "sites": ["site"]}]},
    "notes": {
        "coverage": str, "entries": int, "versions": [{"version": str, "status": str, "(source)": {"kind": str}, "(reason)": str}],
        "matched": [{"version": str, "title": str, "breaking": bool, "direct": bool, "refs": [str], "names": [{"name": str, "certainty": str, "where": str}]}],
        "breakingWithoutApi": [{"version": str, "title": str, "refs": [str]}], "changesWithoutApi": [{"version": str, "title": str, "refs": [str]}],
    },
    "usage": {"files": int, "sites": int, "names": {"exact": [str], "byName": [str]}, "sitesByName": dict, "cannotSee": [{"kind": str, "count": int}]}, "heldBack": [{"version": str, "reason": str}], "(alsoAvailable)": {"version": str, "bump": str},
}
SITE = {"file": str, "line": int, "column": int, "typeOnly": bool, "code": str, "(via)": [str]}


def fits(value, shape):
    if shape == "site":
        shape = SITE
    if isinstance(shape, list):
        return isinstance(value, list) and all(fits(x, shape[0]) for x in value)
    if isinstance(shape, dict):
        names = {k.strip("()"): k for k in shape}
        return isinstance(value, dict) and set(value) <= set(names) and all(fits(value[n], shape[k]) if n in value else k[0] == "(" for n, k in names.items())
    return type(value) is shape


def test_every_document_fits_the_contract(documents):
    for d in documents.values():
        for key in SHAPE:
            name = key.strip("()")
            assert fits({name: d[name]} if name in d else {}, {key: SHAPE[key]}), (d["name"], name)
        assert all(fits(s, "site") for sites in d["usage"]["sitesByName"].values() for s in sites)


def test_read_back_as_written(found):
    kind = found.schema["document"].dataType
    again = found.select("pkg", "document", F.from_json(F.to_json("document"), kind).alias("again"))
    assert again.filter(~F.to_json("document").eqNullSafe(F.to_json("again"))).count() == 0 and again.filter("again.name is null").count() == 0


def test_sections(found):
    told = {}
    for r in records.brief_sections(found).orderBy("pkg", "place").collect():
        told.setdefault(r.pkg, []).append(r.line)
    assert told["ring"] == [
        "#### `ring` 1.0.0 to 1.2.0", "", "blocked, notes complete, used in 2 files", "",
        "- **removed** `ring:Ring#tail`", "  - `a.ts:3`", "- **changed** `ring:make`", "  - `a.ts:3`", "  - `b.ts:9`", "- **deprecated** `ring:Ring#size`", "  - `b.ts:9`",
        "- 1.1.0: Rings keep tail() alive (#4) (perhaps); names `tail`", "  - `a.ts:3`", "- 1.2.0: BREAKING CHANGE: old engines are out (breaking, names no API)", "- 1.2.0: Something else moved (no name ties it to the code)",
        "", "<sub>removed-touched: 1, changed-touched: 1, deprecated-touched: 1, notes-match: 1, unattributed-breaking: 1, unattributed-change: 1, blind-spots: 1</sub>", "",
    ]


def test_fail_gate(spark):
    rows = spark.createDataFrame([("blocked",), ("review",), ("quiet",), (None,)], "v string")
    at = lambda level: [r[0] for r in rows.select(verdicts.fails(F.col("v"), level)).collect()]
    assert at("blocked") == [True, False, False, False] and at("review") == [True, True, False, False] and not any(at("never"))
    with pytest.raises(ValueError):
        verdicts.fails(F.lit("quiet"), "sometimes")


def test_gates_of_hints(spark):
    good = {"refs": 1, "bump": "minor", "code_names": 2, "failed": False, "capped": False, "usable": 3, "share": 0.2}
    cases = [
        (good, None, "computed"), (good | {"refs": 0, "bump": "major"}, "no-usage", "skipped"), (good | {"bump": "major"}, "major", "skipped"), (good | {"code_names": 0, "failed": True}, "no-code-names", "skipped"), (good | {"failed": True}, "unread", "failed"),
        (good | {"capped": True}, "capped", "skipped"), (good | {"usable": 0}, "no-usable-export", "skipped"), (good | {"share": 0.26}, "too-many-changed", "too-many-changed"), (good | {"share": 0.25}, None, "computed"), (good | {"share": None}, "too-many-changed", "too-many-changed"),
    ]
    rows = spark.createDataFrame([(i, *c.values()) for i, (c, *_) in enumerate(cases)], "i int, refs int, bump string, code_names int, failed boolean, capped boolean, usable int, share double")
    assert [(r.hint_reason, r.hint_state) for r in usage.hint_state(rows).orderBy("i").collect()] == [tuple(w) for _, *w in cases]


def test_no_package(spark, project):
    assert assembly.brief(project._replace(installed=project.installed.filter("false")), now()).count() == 0
