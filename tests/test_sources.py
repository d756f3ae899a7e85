"""Readers and writers on small files."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from shiftscope.sources import manifests, records
from shiftscope.streaming import followups


@pytest.fixture
def files(spark, tmp_path):
    def write(path, content):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content if isinstance(content, str) else json.dumps(content))

    write("package.json", {"name": "root", "private": True, "dependencies": {"a": "^1.2.0", "@s/b": "npm:c@2"}, "devDependencies": {"d": "~1.0.0"}, "peerDependencies": {"a": "*", "only-peer": "1"}})
    write("apps/x/package.json", {"name": "x", "dependencies": {"a": "^3.0.0"}})
    write("broken/package.json", "{")
    write("package-lock.json", {"packages": {"": {}, "node_modules/a": {"version": "1.3.0"}, "node_modules/@s/b": {"version": "2.0.1"}, "apps/x/node_modules/a": {"version": "2.9.0"}, "node_modules/a/node_modules/e": {"version": "5.0.0"}}})
    write("y/yarn.lock", '# yarn lockfile v1\n\n"@s/b@npm:^1.0.0", a@^1.2.0:\n  version "1.3.0"\n\n"f@npm:^2":\n  version: 2.2.0\n')
    write("p/pnpm-lock.yaml", "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a:\n        specifier: ^1.2.0\n        version: 1.3.0(peer@1)\n  apps/x:\n    devDependencies:\n      '@s/b':\n        specifier: ^2\n        version: 2.0.1\npackages:\n  a@1.3.0:\n    resolution: {}\n")
    return manifests.text_files(spark, str(tmp_path))


def test_inventory(files):
    found = manifests.manifests(files)
    assert {(r.path, r.name, r.private) for r in found.collect()} == {("package.json", "root", True), ("apps/x/package.json", "x", False)}
    rows = manifests.declared(found)
    assert {(r.dir, r.field, r.key, r.spec_kind, r.name) for r in rows.collect()} == {("", "dependencies", "a", "range", "a"), ("", "dependencies", "@s/b", "alias", "c"), ("", "devDependencies", "d", "range", "d"), ("apps/x", "dependencies", "a", "range", "a")}
    assert manifests.declared(found, production=True).count() == 3
    locked = manifests.npm_locked(files).select(F.col("importer").alias("dir"), "key", "version")
    assert {(r.dir, r.key, r.version) for r in locked.collect()} == {("", "a", "1.3.0"), ("", "@s/b", "2.0.1"), ("apps/x", "a", "2.9.0"), ("node_modules/a", "e", "5.0.0")}
    own = files.filter("path <> 'y/yarn.lock' and path <> 'p/pnpm-lock.yaml'")
    assert {(r.dir, r.key): (r.version, r.version_source) for r in manifests.inventory(rows, own).collect()} == {("", "a"): ("1.3.0", "lockfile"), ("", "@s/b"): ("2.0.1", "lockfile"), ("", "d"): ("1.0.0", "manifest-range"), ("apps/x", "a"): ("2.9.0", "lockfile")}


def test_other_lockfiles(files):
    assert {(r.descriptor, r.version) for r in manifests.yarn_locked(files).collect()} == {("@s/b@^1.0.0", "1.3.0"), ("a@^1.2.0", "1.3.0"), ("f@^2", "2.2.0")}
    assert {(r.importer, r.key, r.specifier, r.version) for r in manifests.pnpm_locked(files).collect()} == {("", "a", "^1.2.0", "1.3.0"), ("apps/x", "@s/b", "^2", "2.0.1")}


def test_nearest_lock(spark, files):
    dirs = spark.createDataFrame([("",), ("apps/x",), ("p/q",)], "dir string")
    assert {r.dir: r.lock for r in manifests.nearest_lock(dirs, files).collect()} == {"": "package-lock.json", "apps/x": "package-lock.json", "p/q": "p/pnpm-lock.yaml"}


def test_records(spark, tmp_path):
    good = {"schema": 1, "entry": "e", "version": "1.0.0", "subjects": ["b", "a", "a"]}
    (tmp_path / "x.json").write_text(json.dumps([good, good, good | {"schema": 2}, {"schema": 1}]))
    assert [(r.entry, r.subjects) for r in records.change_records(spark, str(tmp_path)).collect()] == [("e", ["a", "b"])]


def test_releases(spark):
    doc = {"name": "a", "dist-tags": {"latest": "2.0.0"}, "time": {"1.0.0": "2026-01-01T00:00:00Z"}, "versions": {"1.0.0": {"dist": {"integrity": "sha512-x"}}, "2.0.0": {"deprecated": "old"}}}
    found = records.releases(spark.createDataFrame([(json.dumps(doc),), ("{",)], "content string")).collect()
    assert {(r.pkg, r.version, r.published_at is not None, r.deprecated, r.integrity, r.latest) for r in found} == {("a", "1.0.0", True, False, "sha512-x", "2.0.0"), ("a", "2.0.0", False, True, None, "2.0.0")}


def test_tarballs(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data in (("package/a.js", b"x"), ("package/../b.js", b"y"), ("package/c.d.ts", b"z" * 100)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    rows = spark.createDataFrame([("ok", out.getvalue()), ("bad", b"junk"), ("none", None)], "key string, content binary")
    found = {(r.key, r.path, r.content, r.skipped is not None) for r in records.tarball_files(rows, most=50).collect()}
    assert found == {("ok", "a.js", "x", False), ("ok", "c.d.ts", None, True), ("bad", None, None, True), ("none", None, None, True)}


def test_renderers(spark):
    rows = spark.createDataFrame([("a", "1", "2", "quiet", ["x"]), ("b|c", "1", None, "blocked", ["y", "z"])], "pkg string, from string, to string, verdict string, reasons array<string>")
    lines = [r.line for r in records.brief_markdown(rows).collect()]
    assert lines[2:] == ["| b\\|c | 1 |  | blocked | y, z |", "| a | 1 | 2 | quiet | x |"]
    assert json.loads(records.brief_json(rows).first().value)["pkg"] in ("a", "b|c")


def test_stream(spark, tmp_path):
    data = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    data.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(data.schema).parquet(str(tmp_path / "events"))
    joined = followups.stream_followups(stream().filter("event_type = 'signup'"), stream().filter("event_type = 'purchase'"), "user_id")
    query = joined.writeStream.format("memory").queryName("follow").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    a, b = data.filter("event_type = 'signup'").alias("a"), data.filter("event_type = 'purchase'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id and b.at >= a.at and b.at < a.at + interval 14 days")).count()
    assert spark.table("follow").count() == want > 0
    counted = followups.windowed_counts(stream(), "event_type").writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] > 0.9 * data.count()


def test_cases_and_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"id": "b", "pr": 2, "packages": [{"name": "p", "from": "1", "to": "2"}], "labels": {"check": "weak"}}, indent=2))
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "a", "expected": [{"file": "f", "line": 3, "text": "x", "imports": ["p"]}]}))
    (tmp_path / "in" / "bad.json").write_text("{")
    found = records.cases(spark, str(tmp_path / "in")).collect()
    assert [r.id for r in found] == ["a", "b"] and found[0].expected[0].imports == ["p"] and found[1].labels.check == "weak"
    kind = "repo string, commit string, date string, subject string, pkg string, from string, to string, bump string, verdict string, reasons array<string>, surface string, changes int, touched int, notes string, direct int, possibly int, adapted array<string>, follow_ups array<string>"
    rows = spark.createDataFrame([("r", "0123456789", "2026-01-02T03:04", "s" * 200, "p", "1", "2", "minor", "quiet", ["x"], "computed", 4, 1, "complete", 2, 0, [], ["f"]), ("r", "01", None, "s", "q", "1", "2", None, None, None, None, None, None, None, None, None, None, None)], kind)
    records.write_objects(records.upgrade_rows(rows), str(tmp_path / "out"))
    out = sorted((json.loads(line) for f in (tmp_path / "out").glob("part-*.json") for line in f.read_text().splitlines()), key=lambda r: r["pkg"])
    assert (out[0]["commit"], out[0]["date"], len(out[0]["subject"]), out[0]["surface"], out[0]["followUps"], "error" in out[0]) == ("01234567", "2026-01-02", 100, "computed 4", ["f"], False)
    assert (out[1]["verdict"], out[1]["bump"], out[1]["error"], out[1]["touched"]) == ("not-analysed", "?", "no brief", 0)


def test_names(spark):
    df = spark.createDataFrame([("src/a.js#Store.set", "@s/p"), ("plain", "p")], "u string, p string")
    from shiftscope.functions import paths

    assert [tuple(r) for r in df.select(paths.unit_name(F.col("u")), paths.record_file(F.col("p"), F.lit("1.0.0"))).collect()] == [("set", "@s__p@1.0.0.json"), ("plain", "p@1.0.0.json")]
