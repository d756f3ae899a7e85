"""What a project declares, locks, installs, overrides and patches, on small file tables."""

import json

import pytest
from pyspark.sql import functions as F

from shiftscope.functions import numbers, paths
from shiftscope.sources import installed, manifests


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def files(spark, **found):
    return frame(spark, "path string, content string", *[(p, c if isinstance(c, str) else json.dumps(c)) for p, c in found["of"].items()])


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_specifiers(spark):
    kinds = {
        "^1.0.0": "range", "latest": "tag", "workspace:*": "workspace", "catalog:": "catalog", "npm:typescript@^7": "alias", "file:../x": "file", "link:../y": "link", "github:o/r": "git", "https://x/y.tgz": "url",
        "https://x/y.git": "url", "portal:../z": "range", " ^1.0 ": "range", "next": "tag", "": "range", "owner/name": "git", "./x": "file", "1.x || 2": "range",
    }
    assert column(spark, list(kinds), paths.spec_kind) == list(kinds.values())
    assert column(spark, ["npm:@a/b@^1", "npm:c", "^1"], paths.alias_of) == ["@a/b", "c", None]
    assert column(spark, ["lib/locales", "@a/b/c", "./x", "node:fs", "#internal", "@a"], paths.package_of) == ["lib", "@a/b", None, None, None, None]
    assert column(spark, ["react", "@a/b"], paths.types_package) == ["@types/react", "@types/a__b"]
    assert column(spark, ["@types/react", "@types/a__b", "x"], paths.typed_package) == ["react", "@a/b", None]


def test_durations(spark):
    known = {"0": 0, "90m": 5_400_000, "36h": 129_600_000, "7d": 604_800_000, "1.5h": 5_400_000, "90 minutes": None, "2 W": 1_209_600_000, "x": None, "5": 300_000, "250ms": 250}
    assert column(spark, list(known), numbers.duration_ms) == list(known.values())


def test_integrity(spark):
    df = frame(spark, "c binary", (b"abc",)).withColumn("own", numbers.integrity(F.col("c")))
    told = df.select(numbers.fits_integrity(F.col("c"), F.col("own")), numbers.fits_integrity(F.col("c"), F.concat(F.lit("sha1-AAAA "), "own")), numbers.fits_integrity(F.col("c"), F.lit("sha256-no")), numbers.fits_integrity(F.col("c"), F.lit(None).cast("string"))).first()
    assert tuple(told) == (True, True, False, None)


NPM = {"packages": {
    "": {"dependencies": {"a": "^1.2.0"}}, "apps/x": {"dependencies": {"a": "^2.0.0"}}, "node_modules/a": {"version": "1.3.0"}, "apps/x/node_modules/b": {"version": "2.0.0"},
    "node_modules/b": {"version": "1.0.0"}, "node_modules/l": {"link": True, "version": "9.9.9"}, "node_modules/al": {"name": "real", "version": "3.0.0"},
}}


def test_npm_lookup(spark):
    rows = frame(spark, "lock_dir string, dir string, key string", ("", "", "a"), ("", "apps/x", "a"), ("", "apps/x", "b"), ("", "apps/x/deep", "a"), ("", "", "l"), ("", "", "al"))
    found = {(r.dir, r.key): (r.name, r.version, r.specifier, r.checked) for r in manifests.npm_lookup(rows, files(spark, of={"package-lock.json": NPM})).collect()}
    # a nested manifest that the lockfile doesn't list is no part of the install, links give no version
    assert found == {("", "a"): ("a", "1.3.0", "^1.2.0", True), ("apps/x", "a"): ("a", "1.3.0", "^2.0.0", True), ("apps/x", "b"): ("b", "2.0.0", None, True), ("", "al"): ("real", "3.0.0", None, True)}


def test_bun(spark):
    text = '{ // a comment\n "lockfileVersion": 1, "workspaces": { "": { "dependencies": { "a": "^1.0.0", }, }, "apps/x": {"dependencies": {"a": "^2"}}, },\n "packages": { "a": ["a@1.4.0", "", {}, "sha512-//x"], "w": ["w@workspace:apps/x"], "z": ["real@2.0.0"], } }'
    rows = frame(spark, "lock_dir string, dir string, key string", ("", "", "a"), ("", "apps/x", "a"), ("", "other", "a"), ("", "", "w"), ("", "", "z"))
    found = {(r.dir, r.key): (r.name, r.version, r.specifier) for r in manifests.bun_lookup(rows, files(spark, of={"bun.lock": text})).collect()}
    assert found == {("", "a"): ("a", "1.4.0", "^1.0.0"), ("apps/x", "a"): ("a", "1.4.0", "^2"), ("", "z"): ("real", "2.0.0", None)}


def test_pnpm_forms(spark):
    text = "lockfileVersion: 5.4\nimporters:\n  .:\n    specifiers:\n      a: ^1\n    dependencies:\n      a: 1.3.0\n      old: /old/2.0.0\n      here: link:../x\n  # note\n  apps/x:\n    devDependencies:\n      '@s/b':\n        specifier: npm:real@^2\n        version: real@2.0.1(peer@1)\npackages:\n  a@9:\n    x: 1\n"
    found = {(r.importer, r.key, r.name, r.version, r.specifier, r.checked) for r in manifests.pnpm_locked(files(spark, of={"pnpm-lock.yaml": text})).collect()}
    assert found == {("", "a", "a", "1.3.0", None, False), ("", "old", "old", "2.0.0", None, False), ("apps/x", "@s/b", "real", "2.0.1", "npm:real@^2", True)}


def test_copies(spark):
    found = frame(spark, "path string, real_path string, content string", ("node_modules/a", "node_modules/a", '{"name":"a","version":"1.0.0"}'), ("apps/node_modules/a", "apps/node_modules/a", '{"version":"2.0.0"}'), ("node_modules/w", "packages/w", '{"name":"w","version":"0.1.0"}'), ("apps/node_modules/bad", "x", "{"), ("node_modules/bad", "node_modules/bad", "{}"))
    rows = frame(spark, "dir string, key string", ("apps/x", "a"), ("", "a"), ("apps/x", "w"), ("apps/x", "bad"), ("", "none"))
    told = {(r.dir, r.key): (r.name, r.version, r.local) for r in installed.copies(rows, found).collect()}
    assert told == {("apps/x", "a"): ("a", "2.0.0", False), ("", "a"): ("a", "1.0.0", False), ("apps/x", "w"): ("w", "0.1.0", True)}
    stop = frame(spark, "dir string, stop_at string", ("apps/x", "apps"))
    assert {(r.dir, r.key) for r in installed.copies(rows, found, stop).collect()} == {("apps/x", "a"), ("", "a")}


def test_inventory(spark):
    table = files(spark, of={"package.json": {"dependencies": {"a": "^1.2.0", "b": "^5.0.0", "c": "~3.1", "forced": "^2.0.0", "d": "^1.0.0"}}, "package-lock.json": {"packages": {"": {"dependencies": {"a": "^1.2.0", "b": "^1.0.0", "forced": "^1.0.0", "d": "^1.0.0"}}, "node_modules/a": {"version": "1.3.0"}, "node_modules/b": {"version": "1.0.0"}, "node_modules/forced": {"version": "1.0.0"}, "node_modules/d": {"version": "1.5.0"}}}})
    own = manifests.declared(manifests.manifests(table))
    on_disk = frame(spark, "dir string, key string, name string, version string, local boolean", ("", "a", "a", "1.3.0", False), ("", "d", "d", "1.4.0", False))
    told = {r.key: (r.version, r.version_source, r.flags, [tuple(x) for x in r.out_of_sync]) for r in manifests.inventory(own, table, on_disk, frame(spark, "name string", ("forced",))).collect()}
    assert told["a"] == ("1.3.0", "node_modules", [], [])
    assert told["b"] == ("5.0.0", "manifest-range", ["range-guess"], [("lockfile:npm", "1.0.0")])  # written for another specifier, and not allowed
    assert told["c"] == ("3.1.0", "manifest-range", ["range-guess"], [])
    assert told["forced"] == ("1.0.0", "lockfile", [], [])
    assert told["d"] == ("1.5.0", "lockfile", [], [("node_modules", "1.4.0")])  # the copy is behind the lockfile


def test_declarations(spark):
    table = files(spark, of={"package.json": {"dependencies": {"a": "^1", "w": "workspace:*", "g": "github:o/r"}, "peerDependencies": {"only": "1", "a": "*"}, "devDependencies": {"t": "1"}}})
    assert {(r.key, r.place) for r in manifests.declared(manifests.manifests(table)).collect()} == {("a", "registry"), ("w", "local"), ("g", "elsewhere"), ("t", "registry")}


def test_overrides_and_patches(spark):
    table = files(spark, of={
        "package.json": {"overrides": {"a>b": "1", "c": {".": "2", "d@<2": {"@s/e": "3"}}}, "resolutions": {"**/f": "1"}, "pnpm": {"overrides": {"g": "1"}, "patchedDependencies": {"h@1.0.0": "x", "@s/i@2": "y"}}},
        "pnpm-workspace.yaml": "packages:\n  - x\noverrides:\n  'j': 1\n  k>l: 2\npatchedDependencies:\n  m@1.0.0: p\n", "patches/n+1.2.3.patch": "", "patches/@s+o+1.0.0.patch": "", "patches/@t__q@1.0.0.patch": "",
    })
    assert {r.name for r in installed.overridden(table).collect()} == {"b", "c", "d", "@s/e", "f", "g", "j", "l"}
    assert {r.name for r in installed.patched(table).collect()} == {"h", "@s/i", "m", "n", "@s/o", "@t/q"}


def test_npmrc(spark):
    table = files(spark, of={".npmrc": 'registry=https://r.io/\n@s:registry = "https://s.io/n/"\n//s.io/n/:_authToken=${TOKEN}x\n//s.io/:_authToken=short\n; note\n#x=1\nminimum-release-age=2d\nregistry=https://q.io//', "pnpm-workspace.yaml": "minimumReleaseAge: 60\nminimumReleaseAgeExclude:\n  - 'lib'\n  - \"@s/*\"\n  - a@1.0.0||2.0.0\n"})
    rules = installed.settings(table, {"TOKEN": "t$1"})
    known = installed.registries(rules)
    pkgs = frame(spark, "pkg string", ("@s/a",), ("@o/a",), ("b",))
    assert {r.pkg: r.registry for r in installed.registry_for(pkgs, known).collect()} == {"@s/a": "https://s.io/n", "@o/a": "https://q.io", "b": "https://q.io"}
    urls = frame(spark, "url string", ("https://s.io/n/a",), ("https://s.io/m",), ("http://x/",))
    assert {r.url: r.token for r in installed.authorized(urls, installed.tokens(rules)).collect()} == {"https://s.io/n/a": "t$1x", "https://s.io/m": "short", "http://x/": None}
    age = installed.release_age(table, {}).first()
    assert (age.ms, age.source) == (3_600_000, "pnpm-workspace.yaml minimumReleaseAge")
    asked = frame(spark, "p string, v string", ("lib", "9.0.0"), ("@s/x", "1.0.0"), ("a", "2.0.0"), ("a", "3.0.0"), ("other", "1.0.0"))
    assert [r[0] for r in asked.select(installed.is_age_excluded(F.col("p"), F.col("v"), F.array(*map(F.lit, age.excluded)))).collect()] == [True, True, True, False, False]


def test_types_ranges_and_strings(spark):
    told = column(spark, ['{"types":"x.d.ts"}', '{"typings":""}', '{"exports":{".":{"types":"./a"}}}', '{"exports":"./x.d.mts"}', '{"exports":{".":"./a.js"}}', "{"], installed.declares_types)
    assert told == [True, None, True, True, None, None]
    releases = frame(spark, "name string, version string", ("a", "1.0.0"), ("a", "1.5.0"), ("a", "2.0.0-rc.1"), ("a", "2.0.0-rc.2"))
    tags = frame(spark, "name string, tag string, version string", ("a", "next", "2.0.0-rc.1"), ("a", "gone", "7.0.0"))
    asked = frame(spark, "name string, range string", ("a", "^1.0.0"), ("a", "next"), ("a", "gone"), ("a", ">=2.0.0-rc.1"), ("a", "^3"), ("a", "*"))
    assert {r["range"]: r.version for r in installed.highest(asked, releases, tags).collect()} == {"^1.0.0": "1.5.0", "next": "2.0.0-rc.1", "gone": None, ">=2.0.0-rc.1": "2.0.0-rc.2", "^3": None, "*": "1.5.0"}
    manifest = frame(spark, "pkg string, content string", ("p", json.dumps({"dependencies": {"a": "^1", "@types/b": "2", "c": "1"}, "peerDependencies": {"a": "^0", "@s/d": "*"}})))
    imports = frame(spark, "pkg string, specifier string", ("p", "a/sub"), ("p", "b"), ("p", "./c"), ("p", "@s/d/x"))
    assert {(r.name, r["range"]) for r in installed.imported_dependencies(manifest, imports).collect()} == {("a", "^1"), ("@types/b", "2"), ("@s/d", "*")}
    table = files(spark, of={"package.json": {"name": "n", "dependencies": {"a": "1"}, "eslintConfig": {"extends": ["x", {"deep": "y"}]}}, "c.json": ["s", 1, {"name": "kept"}], "bad.json": "{"})
    assert {(r.path, r.value) for r in installed.all_strings(table).collect()} == {("package.json", "x"), ("package.json", "y"), ("c.json", "s"), ("c.json", "kept")}
    bins = frame(spark, "pkg string, content string", ("@s/tool", None), ("one", '{"bin":"x.js","name":"@s/one"}'), ("many", '{"bin":{"m1":"a","m2":"b"}}'), ("none", "{}"))
    assert {(r.pkg, r.bin) for r in installed.binaries(bins).collect()} == {("@s/tool", "tool"), ("one", "one"), ("many", "m1"), ("many", "m2")}


@pytest.mark.parametrize("declared,want", [("^1.2.0", "1.2.0"), ("~1", "1.0.0"), ("1.x", "1.0.0"), (">=2.3", "2.3.0"), ("1.0.0-rc.1", "1.0.0-rc.1"), ("next", None), ("*", "0.0.0")])
def test_lowest(spark, declared, want):
    assert column(spark, [declared], manifests.lowest) == [want]
