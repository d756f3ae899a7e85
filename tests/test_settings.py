"""Path aliases along inherited settings, and packages that only settings, style sheets and conventions name."""

import json

from shiftscope.operators import usage
from shiftscope.sources import settings


def files(spark, **contents):
    rows = [(p.replace("__", "/").replace("_dot_", "."), c if isinstance(c, str) else json.dumps(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, content string")


def table(spark, rows):
    return spark.createDataFrame([(p, c if isinstance(c, str) else json.dumps(c)) for p, c in rows.items()], "path string, content string")


PROJECT = {
    "tsconfig.json": {"extends": "./base", "compilerOptions": {"baseUrl": "src"}},
    "base.json": """{ // shared
        "compilerOptions": { "paths": { "@/*": ["./lib/*", "gen/*",], "#exact": ["one.ts"], "pre-*-post": ["p/*/q"], /* wide */ "*": ["any/*"] }, },
    }""",
    "app/tsconfig.json": {"extends": ["../none.json", "../base.json", "./local"]},
    "app/local.json": {"extends": "../base.json", "compilerOptions": {"paths": {"~/*": ["./own/*"]}}},
    "app/deep/jsconfig.json": {"compilerOptions": {}},
    "bad/tsconfig.json": "{ not json",
    "loop/tsconfig.json": {"extends": "./tsconfig.json"},
    "pkg/tsconfig.json": {"extends": "some-package/tsconfig", "compilerOptions": {"baseUrl": "."}},
}


def test_settings_along_extends(spark):
    found = {r.path: (r.base, [(p.pattern, p.targets) for p in r.paths], r.root) for r in settings.path_settings(table(spark, PROJECT)).collect()}
    shared = [("@/*", ["./lib/*", "gen/*"]), ("#exact", ["one.ts"]), ("pre-*-post", ["p/*/q"]), ("*", ["any/*"])]
    assert found == {
        "base.json": (None, shared, ""), "tsconfig.json": ("src", shared, "src"), "app/local.json": (None, [("~/*", ["./own/*"])], "app"), "app/tsconfig.json": (None, [("~/*", ["./own/*"])], "app"), "pkg/tsconfig.json": ("pkg", [], "pkg"),
    }


def test_no_more_than_five_files_are_followed(spark):
    chain = {f"c{k}/tsconfig.json": {"extends": f"../c{k + 1}/tsconfig.json"} for k in range(7)} | {"c7/tsconfig.json": {"compilerOptions": {"baseUrl": "x"}}}
    assert {r.path for r in settings.path_settings(table(spark, chain)).collect()} == {f"c{k}/tsconfig.json" for k in range(2, 8)}


def test_aliases(spark):
    documents = table(spark, PROJECT)
    sources = ["a.ts", "src/lib/x.ts", "src/gen/y/index.tsx", "src/one.ts", "src/p/mid/q.js", "src/any/z.ts", "src/direct.ts", "app/own/w.mts", "app/m.ts", "app/deep/n.ts", "pkg/k.ts", "pkg/ring/index.ts", "pkg/free.ts", "src/gen/both.ts", "src/lib/both.ts"]
    paths = spark.createDataFrame([(p,) for p in sources], "path string")
    nearest = settings.nearest_settings(paths, documents, settings.path_settings(documents))
    assert {r.file: r.root for r in nearest.filter("file in ('a.ts', 'app/m.ts', 'app/deep/n.ts', 'pkg/k.ts')").collect()} == {"a.ts": "src", "app/m.ts": "app", "app/deep/n.ts": "app", "pkg/k.ts": "pkg"}
    asked = [("a.ts", s) for s in ("@/x", "@/y", "@/both", "@/none", "#exact", "pre-mid-post", "pre-post", "z", "direct", "./src/one", "node:fs")] + [("app/m.ts", "~/w.mjs"), ("app/deep/n.ts", "~/w"), ("app/m.ts", "@/x"), ("pkg/k.ts", "ring"), ("pkg/k.ts", "free"), ("pkg/k.ts", "@free")]
    imports = spark.createDataFrame(asked, "file string, specifier string")
    installed = spark.createDataFrame([("ring",), ("z",)], "pkg string")
    found = settings.aliased(imports, nearest, paths, installed)
    assert {(r.file, r.specifier): r.target for r in found.collect()} == {
        ("a.ts", "@/x"): "src/lib/x.ts", ("a.ts", "@/y"): "src/gen/y/index.tsx", ("a.ts", "@/both"): "src/lib/both.ts", ("a.ts", "#exact"): "src/one.ts", ("a.ts", "pre-mid-post"): "src/p/mid/q.js",
        ("a.ts", "z"): "src/any/z.ts", ("a.ts", "direct"): "src/direct.ts", ("app/m.ts", "~/w.mjs"): "app/own/w.mts", ("app/deep/n.ts", "~/w"): "app/own/w.mts", ("pkg/k.ts", "free"): "pkg/free.ts",
    }
    whole = usage.resolved(imports.withColumns({"local": imports.specifier, "imported": imports.specifier}), paths, installed, found)
    told = {(r.file, r.specifier): (r.target, r.pkg, r.unresolved) for r in whole.collect()}
    assert told["a.ts", "z"] == ("src/any/z.ts", None, False) and told["pkg/k.ts", "ring"] == (None, "ring", False) and told["a.ts", "./src/one"] == ("src/one.ts", None, False) and told["a.ts", "@/none"] == (None, None, True)


NAMES = [("ring", "ring"), ("@a/pool", "@a/pool"), ("alias", "real")]


def test_packages_in_settings(spark):
    documents = table(spark, {"ring.config.js": "x", ".poolrc": '{\n "plugins": ["@a/pool/extra", "ring"],\n "z": "./ring"}', "package.json": '{\n\n "ring": "alias/x"}', "src/a.json": '{"a": "ring"}'})
    strings = spark.createDataFrame([(".poolrc", "@a/pool/extra"), (".poolrc", "ring"), (".poolrc", "./ring"), ("package.json", "alias/x"), ("src/a.json", "ring"), ("ring.config.js", "ringing"), ("ring.config.js", "ring")], "path string, value string")
    names = spark.createDataFrame(NAMES, "name string, pkg string")
    found = settings.config_references(strings, documents, names)
    assert {(r.pkg, r.kind, r.path, r.line) for r in found.collect()} == {("@a/pool", "config-reference", ".poolrc", 2), ("ring", "config-reference", ".poolrc", 2), ("real", "config-reference", "package.json", 3), ("ring", "config-reference", "ring.config.js", 1)}


def test_packages_in_style_sheets(spark):
    text = '/* top */\n@import "ring/base.css";\n\n@plugin\n  "@a/pool";\n.x { color: red }\n@use \'~alias\'; @import url("./own.css"); @import url( "ring" );\n'
    documents = table(spark, {"s/a.scss": text, "b.css": ".y {}", "c.ts": '@import "ring"'})
    found = settings.style_imports(documents, spark.createDataFrame(NAMES, "name string, pkg string"))
    assert {(r.pkg, r.path, r.line) for r in found.collect()} == {("ring", "s/a.scss", 2), ("@a/pool", "s/a.scss", 4), ("real", "s/a.scss", 7), ("ring", "s/a.scss", 7)}


def test_frameworks_by_place(spark):
    found = settings.conventions(spark.createDataFrame([("next", "b/package.json"), ("next", "a/package.json"), ("ring", "package.json")], "pkg string, manifest string"))
    assert [(r.pkg, r.kind, r.path) for r in found.collect()] == [("next", "convention-framework", "a/package.json")]
