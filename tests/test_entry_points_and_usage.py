"""Entry points of export maps, scripts of components, what files hand on, and options that are passed."""

import json

from pyspark.sql import functions as F

from shiftscope.functions import numbers
from shiftscope.operators import usage
from shiftscope.sources import entry_points, records


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def manifests(spark, **found):
    return frame(spark, "pkg string, content string", *[(k, json.dumps(v)) for k, v in found.items()])


def files(spark, **found):
    return frame(spark, "pkg string, path string", *[(k, p) for k, paths in found.items() for p in paths])


def test_types(spark):
    own = manifests(spark, a={"exports": {".": {"import": {"types": "./m.d.mts", "default": "./m.mjs"}, "require": "./c.cjs", "custom": "./src.ts"}, "./package.json": "./package.json", "./none": None, "./list": [{"node": "./gone.js"}, "./l.js"]}}, b={"exports": {"types": "./x.d.ts"}}, c={"exports": {"./f/*": "./dist/*.js"}}, d={"types": "t.d.ts"}, e={"main": "lib/e"}, f={"typesVersions": {"<4.0": {"*": ["old/*"]}, "*": {"*": ["new/*"]}}, "types": "./i.d.ts"})
    table = files(spark, a=["m.d.mts", "c.d.ts", "l.d.ts", "src.d.ts"], b=["x.d.ts"], c=[f"dist/{n:03d}.js" for n in range(60)] + [f"dist/{n:03d}.d.ts" for n in range(60)] + ["dist/deep/x.js"], d=["t.d.ts", "sub.d.ts"], e=["lib/e/index.d.ts"], f=["new/i.d.ts"])
    wanted = frame(spark, "pkg string, subpath string", ("c", "./f/055"), ("d", "./sub"))
    found = {(r.pkg, r.subpath): (r.file, r.truncated) for r in entry_points.type_entries(own, table, wanted).collect()}
    assert {k: v for k, v in found.items() if k[0] != "c"} == {("a", "."): ("m.d.mts", False), ("a", "./list"): ("l.d.ts", False), ("b", "."): ("x.d.ts", False), ("d", "."): ("t.d.ts", False), ("d", "./sub"): ("sub.d.ts", False), ("e", "."): ("lib/e/index.d.ts", False), ("f", "."): ("new/i.d.ts", False)}
    assert len([k for k in found if k[0] == "c"]) == 51 and found["c", "./f/055"] == ("dist/055.d.ts", True)


def test_runtime(spark):
    own = manifests(spark, a={"exports": {".": {"types": "./t.d.ts", "default": "./d.js", "import": "./i.mjs", "require": "./r.cjs"}}}, b={"main": "lib", "module": "es/index.js"}, c={})
    table = files(spark, a=["d.js", "i.mjs", "r.cjs"], b=["lib/index.js", "es/index.js"], c=["index.js"])
    of = lambda build: {r.pkg: r.file for r in entry_points.runtime_entries(own, table, build).collect()}
    assert of("require") == {"a": "d.js", "b": "lib/index.js", "c": "index.js"}  # the map's own order decides
    assert of("import") == {"a": "d.js", "b": "es/index.js", "c": "index.js"}
    assert {r.pkg: r.flavor for r in entry_points.flavor(own, own).collect()} == {"a": "import", "b": "import", "c": "require"}


def test_workspace(spark):
    own = manifests(spark, w={"exports": {".": {"dev": "./src/i.ts", "import": "./i.js"}, "./a": "./a.js", "./*": {"types": "./t/*.d.ts"}}})
    asked = frame(spark, "pkg string, subpath string", ("w", "."), ("w", "./a"), ("w", "./b/c"), ("w", "x"))
    assert {r.subpath: r.target for r in entry_points.workspace_targets(own, asked).collect()} == {".": "./i.js", "./a": "./a.js", "./b/c": "./t/b/c.d.ts"}


def test_scripts(spark):
    vue = "<template>\n</template>\n<script setup lang=\"ts\">\nconst a = 1\n</script>\n<style/>\n<script>\nx\n</script>"
    astro = "---\nconst b = 2\n---\n<p/>\n<script>y</script>"
    rows = frame(spark, "path string, content string", ("a.vue", vue), ("b.astro", astro), ("c.TSX", "z"), ("d.mjs", "w"), ("e.css", "no"), ("f.js", "x" * 1_500_001), ("g.js", "y" * 6000))
    found = {(r.path, r.block): (r.skipped, r.kind, r.line_offset, r.text if r.text is None or len(r.text) < 30 else "") for r in records.source_blocks(rows).collect()}
    assert found == {("a.vue", 0): (None, "ts", 2, "\nconst a = 1\n"), ("a.vue", 1): (None, "js", 6, "\nx\n"), ("b.astro", 0): (None, "ts", 1, "const b = 2"), ("b.astro", 1): (None, "ts", 4, "y"), ("c.TSX", 0): (None, "tsx", 0, "z"), ("d.mjs", 0): (None, "js", 0, "w"), ("f.js", None): ("too-large", None, None, None), ("g.js", None): ("generated", None, None, None)}


def test_verified_tarballs(spark):
    tarballs = frame(spark, "key string, content binary", ("a", b"x"), ("b", b"x"), ("c", b"x"))
    good = tarballs.filter("key = 'a'").select("key", numbers.integrity(F.col("content")).alias("integrity"))
    known = good.unionByName(frame(spark, "key string, integrity string", ("b", "sha512-AAAA")))
    assert {(r.key, r.content is None, r.reason) for r in records.verified(tarballs, known).collect()} == {("a", False, None), ("b", True, "integrity-mismatch"), ("c", False, "unchecked")}


def test_files_that_hand_on(spark):
    edges = frame(spark, "file string, target string, pkg string", ("a", "b", None), ("b", "c", None), ("c", "a", None), ("c", None, "p"), ("b", None, "q"), ("z", None, "r"))
    found, cut = usage.forwarded(edges)
    assert {(r.file, r.pkg) for r in found.collect()} == {(f, p) for f in "abc" for p in "pq"} | {("z", "r")} and not cut
    entries = frame(spark, "file string, private boolean", ("a", None), ("z", True))
    assert {(r.pkg, r.file) for r in usage.public_reexports(entries, found).collect()} == {("p", "a"), ("q", "a")}


def test_options_and_exports(spark):
    refs = frame(spark, "pkg string, file string, line int, col int, via string", ("p", "f", 1, 2, None), ("p", "f", 9, 9, None))
    passed = frame(spark, "file string, line int, col int, key string, key_line int", ("f", 1, 2, "quiet", 3), ("f", 1, 2, "same", 1))
    assert {(r.option, r.line) for r in usage.passed_options(refs, passed).collect()} == {("quiet", 1), ("quiet", 3), ("same", 1)}
    kind = "pkg string, prefix string, binding string, names array<string>, called boolean, file string, line int"
    refs = frame(spark, kind, ("p", "p", "named", ["Store", "create"], False, "f", 1), ("p", "p", "default", ["get"], False, "f", 2), ("p", "p", "namespace", ["use"], True, "f", 3), ("p", "p", "named", ["unknown"], False, "f", 4), ("p", "p/sub", "named", ["gone"], False, "f", 5))
    exports = frame(spark, "pkg string, path string", ("p", "p:Store"), ("p", "p:Store#create"), ("p", "p:default#get"), ("p", "p:#use"), ("p", "p:default"))
    assert {(r.path, r.line) for r in usage.used_exports(refs, exports).collect()} == {("p:Store", 1), ("p:Store#create", 1), ("p:default#get", 2), ("p:#use", 3), ("p:default", 4)}
    share = usage.changed_share(exports, frame(spark, "pkg string, path string", ("p", "p:Store")), frame(spark, "pkg string, path string", ("p", "p:Store"), ("p", "p:#use")))
    assert [r.share for r in share.collect()] == [0.5]
