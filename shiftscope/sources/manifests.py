"""Package manifests, lockfiles and what is installed, read as tables.

Files are a table: path string, content string (from `text_files`, or any other source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, semver
from ..operators import graphs

# The blocks in which a manifest declares dependencies, and the lockfiles known, the first before the others.
BLOCKS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
LOCKFILES = ["pnpm-lock.yaml", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "bun.lock"]


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), content of all files under root whose name fits; links and binary folders are the lister's concern."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    return found.select(F.substr(path, F.length(base) + 2).alias("path"), F.decode("content", "UTF-8").alias("content"))


def manifests(files: DataFrame) -> DataFrame:
    """path, dir, name, version, private, and a map for each block; files that aren't JSON objects are left out."""
    own = files.filter(F.col("path").rlike(r"(^|/)package\.json\z")).withColumn("json", F.try_parse_json("content"))
    text = lambda k: F.try_variant_get("json", f"$.{k}", "string")
    blocks = [F.try_variant_get("json", f"$.{b}", "map<string,string>").alias(b) for b in BLOCKS]
    return own.filter(F.schema_of_variant("json").startswith("OBJECT")).select("path", F.regexp_replace("path", r"/?package\.json\z", "").alias("dir"), text("name").alias("name"), text("version").alias("version"), F.coalesce(F.try_variant_get("json", "$.private", "boolean"), F.lit(False)).alias("private"), *blocks)


def declared(found: DataFrame, production: bool = False) -> DataFrame:
    """manifest, dir, field, key, spec, spec_kind, name, place of all declarations.

    A peer that is declared nowhere else in its manifest is dropped, as are development ones for production. place: local
    (the project's own: workspace, link, file), elsewhere (git, an address: not from a registry) or registry.
    """
    rows = None
    for block in BLOCKS:
        part = found.select(F.col("path").alias("manifest"), "dir", F.lit(block).alias("field"), F.explode(block).alias("key", "spec"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.filter("spec is not null").withColumns({"spec_kind": paths.spec_kind(F.col("spec")), "name": F.coalesce(paths.alias_of(F.col("spec")), F.col("key"))})
    firm = F.max((F.col("field") != "peerDependencies").cast("int")).over(Window.partitionBy("manifest", "key"))
    place = F.when(F.col("spec_kind").isin("workspace", "link", "file"), "local").when(F.col("spec_kind").isin("git", "url"), "elsewhere").otherwise("registry")
    kept = rows.withColumns({"firm": firm, "place": place}).filter((F.col("firm") == 1) & (F.col("field") != "peerDependencies")).drop("firm")
    return kept.filter("field <> 'devDependencies'") if production else kept


def _locked_files(files: DataFrame, names: str) -> DataFrame:
    """lock_dir, content of lockfiles of these names (a pattern)."""
    return files.filter(F.col("path").rlike(rf"(^|/)({names})\z")).select(F.regexp_replace("path", r"/?[^/]+\z", "").alias("lock_dir"), "content")


def _below(path: Column, folder: Column) -> Column:
    """A path as seen from a folder above it; null if it isn't below."""
    return F.when(folder == "", path).when(path == folder, F.lit("")).when(F.startswith(path, F.concat(folder, F.lit("/"))), F.substr(path, F.length(folder) + 2))


def npm_locked(files: DataFrame) -> DataFrame:
    """lock_dir, importer, key, name, version, link, at: packages of npm lockfiles (versions 2 and 3) by the folder that holds them."""
    own = _locked_files(files, r"package-lock\.json|npm-shrinkwrap\.json").select("lock_dir", F.try_parse_json("content").alias("json"))
    packages = F.try_variant_get("json", "$.packages", "map<string,variant>")
    each = own.select("lock_dir", F.explode(packages).alias("at", "p"))
    at = r"^(.*/)?node_modules/((?:@[^/]+/)?[^/]+)\z"
    importer = F.regexp_replace(F.regexp_extract("at", at, 1), r"/\z", "")
    get = lambda path, kind: F.try_variant_get("p", path, kind)
    key = F.regexp_extract("at", at, 2)
    return each.filter(F.col("at").rlike(at)).select("lock_dir", importer.alias("importer"), key.alias("key"), F.coalesce(get("$.name", "string"), key).alias("name"), get("$.version", "string").alias("version"), F.coalesce(get("$.link", "boolean"), F.lit(False)).alias("link"), "at")


def npm_importers(files: DataFrame) -> DataFrame:
    """lock_dir, importer, declares (a map of what it was locked for, null if none is recorded) of npm lockfiles' own folders."""
    own = _locked_files(files, r"package-lock\.json|npm-shrinkwrap\.json").select("lock_dir", F.try_parse_json("content").alias("json"))
    each = own.select("lock_dir", F.explode(F.try_variant_get("json", "$.packages", "map<string,variant>")).alias("importer", "p")).filter(~F.col("importer").rlike("(^|/)node_modules/"))
    blocks = [F.try_variant_get("p", f"$.{b}", "map<string,string>") for b in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")]
    none = F.lit(None).cast("map<string,string>")
    some = F.array_compact(F.array(*blocks))
    entries = F.flatten(F.transform(some, lambda m: F.map_entries(m)))
    # of one key the first block counts
    kept = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["key"]), e["key"]) == i + 1))
    return each.select("lock_dir", "importer", F.when(F.size(some) > 0, kept).otherwise(none).alias("declares"))


def npm_lookup(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """lock_dir, dir, key, name, version, specifier, checked of declarations (lock_dir, dir, key) in npm lockfiles.

    A package is looked for in the declaring folder's own node_modules and then in each above it, as Node does. A nested
    manifest that a lockfile with recorded importers doesn't list is no part of the install. specifier: what the lockfile
    was written for (null if it has none for the key); checked: whether it records that.
    """
    rows = declarations.select("lock_dir", "dir", "key").distinct().withColumn("below", _below(F.col("dir"), F.col("lock_dir"))).filter("below is not null")
    own = npm_importers(files)
    root = own.filter("importer = ''").select("lock_dir", F.col("declares").isNotNull().alias("records"))
    told = rows.join(own.withColumnRenamed("importer", "below"), ["lock_dir", "below"], "left").withColumn("listed", F.col("declares").isNotNull()).join(root, "lock_dir", "left")
    present = own.select("lock_dir", F.col("importer").alias("below"), F.lit(True).alias("present"))
    told = told.join(present, ["lock_dir", "below"], "left").filter((F.col("below") == "") | F.col("present") | ~F.coalesce("records", F.lit(False)))
    above = told.withColumn("importer", F.explode(paths.folders(F.concat(F.col("below"), F.lit("/x")))))
    locked = npm_locked(files).filter(~F.col("link") & F.col("version").isNotNull()).select("lock_dir", "importer", "key", "name", "version")
    near = above.join(locked, ["lock_dir", "importer", "key"]).groupBy("lock_dir", "dir", "key").agg(F.max_by(F.struct("name", "version", F.try_element_at("declares", F.col("key")).alias("specifier"), F.col("listed").alias("checked")), F.length("importer")).alias("hit"))
    return near.select("lock_dir", "dir", "key", "hit.name", "hit.version", "hit.specifier", F.coalesce("hit.checked", F.lit(False)).alias("checked"))


def plain_json(text: Column) -> Column:
    """JSON text without comments and commas before a closing bracket."""
    out = F.regexp_replace(text, r'("(?:[^"\\]++|\\.)*+")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(out, r'("(?:[^"\\]++|\\.)*+")|,(?=\s*[}\]])', "$1")


def bun_locked(files: DataFrame) -> DataFrame:
    """lock_dir, key, name, version of bun lockfiles; what isn't a version of a registry is left out."""
    own = _locked_files(files, r"bun\.lock").select("lock_dir", F.try_parse_json(plain_json(F.col("content"))).alias("json"))
    each = own.select("lock_dir", F.explode(F.try_variant_get("json", "$.packages", "map<string,variant>")).alias("key", "p"))
    ident = F.try_variant_get("p", "$[0]", "string")
    return each.select("lock_dir", "key", F.regexp_extract(ident, r"^(.+)@([^@]*)\z", 1).alias("name"), F.regexp_extract(ident, r"^(.+)@([^@]*)\z", 2).alias("version")).filter(F.col("version").rlike(r"^\d"))


def bun_lookup(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """As npm_lookup, of bun lockfiles: a nested manifest that isn't a listed workspace is no part of the install."""
    own = _locked_files(files, r"bun\.lock").select("lock_dir", F.try_parse_json(plain_json(F.col("content"))).alias("json"))
    spaces = own.select("lock_dir", F.explode_outer(F.try_variant_get("json", "$.workspaces", "map<string,variant>")).alias("below", "w"))
    blocks = F.array_compact(F.array(*[F.try_variant_get("w", f"$.{b}", "map<string,string>") for b in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")]))
    listed = spaces.filter("below is not null").select("lock_dir", "below", blocks.alias("blocks"), F.lit(True).alias("listed"))
    some = listed.select("lock_dir").distinct().withColumn("lists", F.lit(True))
    rows = declarations.select("lock_dir", "dir", "key").distinct().withColumn("below", _below(F.col("dir"), F.col("lock_dir"))).filter("below is not null")
    met = rows.join(listed, ["lock_dir", "below"], "left").join(some, "lock_dir", "left").filter((F.col("below") == "") | F.col("listed") | F.col("lists").isNull())
    # of one key the first block counts
    spec = F.get(F.filter(F.transform("blocks", lambda m: F.try_element_at(m, F.col("key"))), lambda x: x.isNotNull()), F.lit(0))
    hit = met.join(bun_locked(files), ["lock_dir", "key"])
    return hit.select("lock_dir", "dir", "key", "name", "version", spec.alias("specifier"), F.coalesce(F.size("blocks") > 0, F.lit(False)).alias("checked"))


def yarn_locked(files: DataFrame) -> DataFrame:
    """lock_dir, descriptor (key@spec), version of yarn lockfiles of both generations, entry by entry."""
    own = files.filter(F.col("path").rlike(r"(^|/)yarn\.lock\z")).select(F.regexp_replace("path", r"/?[^/]+\z", "").alias("lock_dir"), F.explode(F.split("content", r"\n\s*\n")).alias("entry"))
    head = F.regexp_extract("entry", r"(?m)^([^\s#][^\n]*):\s*$", 1)
    version = F.regexp_extract("entry", r"(?m)^\s+version:?\s+\"?([^\"\s]+)\"?", 1)
    each = own.select("lock_dir", F.explode(F.split(F.regexp_replace(head, '"', ""), r",\s*")).alias("descriptor"), version.alias("version"))
    return each.filter("descriptor <> '' and version <> ''").withColumn("descriptor", F.regexp_replace("descriptor", r"^(@?[^@]+)@npm:", "$1@"))


def pnpm_locked(files: DataFrame) -> DataFrame:
    """lock_dir, importer, key, name, specifier, version, checked of pnpm lockfiles' importers, by indentation.

    Both forms are read: `name: version` (version 5) and a block with specifier and version. Peers behind a version, an
    alias before it and the old spelling /name/version are taken off; links and files are left out. checked: whether the
    importer records specifiers. Lines of one file are numbered and each takes the nearest line above of every lower depth.
    """
    own = files.filter(F.col("path").rlike(r"(^|/)pnpm-lock\.yaml\z")).select(F.regexp_replace("path", r"/?[^/]+\z", "").alias("lock_dir"), F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))
    by = Window.partitionBy("lock_dir").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    quotes = r"^(['\"])(.*)\1\z"
    bare = lambda c: F.regexp_replace(c, quotes, "$2")
    key = bare(F.regexp_extract("line", r"^\s*(.+?):(\s.*)?\z", 1))
    depth = F.length(F.regexp_extract("line", r"^( *)", 1))
    rows = own.filter(F.col("line").rlike(r"^\s*[^\s#]")).withColumns({"depth": depth, "key": key, "value": bare(F.regexp_extract("line", r":\s+(.*?)\s*\z", 1))})
    # a name holds only until the next line of a lower depth
    nearest = lambda d: F.last(F.when(F.col("depth") == d, F.struct("pos", "key")), ignorenulls=True).over(by)
    told = rows.withColumns({"top": nearest(0), "of": nearest(2), "block": nearest(4), "dep": nearest(6)})
    inside = told.filter((F.col("top.key") == "importers") & F.col("block.key").isin("dependencies", "devDependencies", "optionalDependencies") & (F.col("of.pos") > F.col("top.pos")) & (F.col("block.pos") > F.col("of.pos")) & (F.col("dep.pos") > F.col("block.pos")))
    leaves = inside.filter(((F.col("depth") == 6) & (F.col("value") != "")) | ((F.col("depth") == 8) & F.col("key").isin("specifier", "version")))
    of = lambda cond: F.max(F.when(cond, F.col("value")))
    out = leaves.groupBy("lock_dir", F.col("of.key").alias("importer"), F.col("block.key").alias("field"), F.col("dep.key").alias("name")).agg(of((F.col("depth") == 8) & (F.col("key") == "specifier")).alias("specifier"), of((F.col("depth") == 6) | (F.col("key") == "version")).alias("raw"))
    cut = F.regexp_replace("raw", r"\(.*\z", "")
    alias = r"^(@?[^@]+)@(\d.*)\z"
    version = F.regexp_replace(F.when(cut.rlike(alias), F.regexp_extract(cut, alias, 2)).otherwise(cut), r"^/.*/", "")
    checked = F.max(F.col("specifier").isNotNull().cast("int")).over(Window.partitionBy("lock_dir", "importer")) == 1
    named = out.withColumns({"version": version, "alias": F.regexp_extract(cut, alias, 1), "checked": checked}).filter(~F.col("raw").rlike("^(link|file):") & F.col("version").rlike(r"^\d"))
    return named.select("lock_dir", F.when(F.col("importer") == ".", "").otherwise(F.col("importer")).alias("importer"), F.col("name").alias("key"), F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("name")).alias("name"), "specifier", "version", "checked")


def nearest_lock(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """dir, lock: the lockfile nearest above each folder; in one folder the first of LOCKFILES."""
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    rank = F.array_position(F.array(*map(F.lit, LOCKFILES)), name)
    locks = files.filter(name.isin(*LOCKFILES)).select(F.regexp_replace("path", r"/?[^/]+\z", "").alias("above"), F.col("path").alias("lock"), rank.alias("rank"))
    above = dirs.select("dir").distinct().withColumn("above", F.explode(paths.folders(F.concat(F.col("dir"), F.lit("/x")))))
    best = above.join(locks, "above").groupBy("dir").agg(F.min_by("lock", F.struct(-F.length("above"), F.col("rank"))).alias("lock"))
    return dirs.select("dir").distinct().join(best, "dir", "left")


def hits(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """dir, key, spec, lock, name, version, specifier, checked, source: each declaration's entry in the lockfile nearest above its folder."""
    rows = declarations.select("dir", "key", "spec").distinct().join(nearest_lock(declarations, files), "dir").filter("lock is not null")
    kind = F.regexp_extract("lock", r"([^/]+)\z", 1)
    rows = graphs.written(rows.withColumns({"kind": kind, "lock_dir": F.regexp_replace("lock", r"/?[^/]+\z", "")}), "locks")
    known = {r["kind"] for r in rows.select("kind").distinct().collect()}  # of LOCKFILES
    out = ["dir", "key", "spec", "lock", "name", "version", "specifier", "checked", "source"]
    found = rows.select("dir", "key", "spec", "lock", *[F.lit(None).cast("string").alias(c) for c in ("name", "version", "specifier")], F.lit(False).alias("checked"), F.lit("").alias("source")).filter("false")
    if known & {"package-lock.json", "npm-shrinkwrap.json"}:
        npm = rows.filter(F.col("kind").isin("package-lock.json", "npm-shrinkwrap.json"))
        found = found.unionByName(npm.join(npm_lookup(npm, files), ["lock_dir", "dir", "key"]).withColumn("source", F.lit("npm")).select(*out))
    if "bun.lock" in known:
        bun = rows.filter("kind = 'bun.lock'")
        found = found.unionByName(bun.join(bun_lookup(bun, files), ["lock_dir", "dir", "key"]).withColumn("source", F.lit("bun")).select(*out))
    if "pnpm-lock.yaml" in known:
        pnpm = rows.filter("kind = 'pnpm-lock.yaml'").withColumn("importer", _below(F.col("dir"), F.col("lock_dir")))
        found = found.unionByName(pnpm.join(pnpm_locked(files), ["lock_dir", "importer", "key"]).withColumn("source", F.lit("pnpm")).select(*out))
    if "yarn.lock" in known:
        yarn = rows.filter("kind = 'yarn.lock'").withColumn("descriptor", F.concat("key", F.lit("@"), F.regexp_replace("spec", "^npm:", "")))
        berry = yarn_locked(files).groupBy("lock_dir", "descriptor").agg(F.max("version").alias("version"))
        met = yarn.join(berry, ["lock_dir", "descriptor"]).withColumns({"name": F.coalesce(paths.alias_of(F.col("spec")), F.col("key")), "specifier": F.col("spec"), "checked": F.lit(True), "source": F.lit("yarn")})
        found = found.unionByName(met.select(*out))
    return found.dropDuplicates(["dir", "key", "spec"])


def inventory(declarations: DataFrame, files: DataFrame, installed: DataFrame | None = None, overridden: DataFrame | None = None) -> DataFrame:
    """declarations with name, version, version_source (node_modules, lockfile, manifest-range), flags, out_of_sync: what each installs.

    installed: dir, key, name, version, local (installed.copies); overridden: name. A lockfile written for another
    specifier is stale if it is also outside what the manifest allows, unless the name is overridden. A copy is
    behind if it differs from a lockfile written for this specifier, or with a stale one if the manifest doesn't allow it.
    A range's lowest version is a guess. Nothing declared is dropped; a linked copy is local.
    """
    hit = hits(declarations, files).select("dir", "key", "spec", F.col("name").alias("l_name"), F.col("version").alias("l_version"), "specifier", "checked", "source")
    met = declarations.join(hit, ["dir", "key", "spec"], "left")
    if installed is not None:
        met = met.join(installed.select("dir", "key", F.col("name").alias("i_name"), F.col("version").alias("i_version"), F.col("local").alias("i_local")), ["dir", "key"], "left")
    else:
        met = met.withColumns({"i_name": F.lit(None).cast("string"), "i_version": F.lit(None).cast("string"), "i_local": F.lit(False)})
    if overridden is not None:
        met = met.join(overridden.select(F.col("name").alias("key"), F.lit(True).alias("forced")).distinct(), "key", "left")
    else:
        met = met.withColumn("forced", F.lit(False))
    limits = F.col("spec_kind").isin("range", "alias")
    allows = lambda v: ~limits | F.coalesce(semver.satisfies(v, "wanted"), F.lit(True))
    has, copy = F.col("l_version").isNotNull(), F.col("i_version").isNotNull()
    # written, as ranges are long expressions that each of the columns below would repeat
    met = met.withColumn("wanted", paths.range_of(F.col("spec")))
    met = graphs.written(met.withColumns({"lock_fits": allows("l_version"), "copy_fits": allows("i_version") if installed is not None else F.lit(True), "guess": F.when(limits, lowest(F.col("wanted")))}), "declarations")
    guess = F.col("guess")
    recorded = F.coalesce(F.col("checked") & (F.col("specifier") == F.col("spec")), F.lit(False))
    stale = has & F.coalesce("checked", F.lit(False)) & ~recorded & ~F.coalesce("forced", F.lit(False)) & ~F.col("lock_fits")
    behind = copy & ~F.coalesce("i_local", F.lit(False)) & has & F.when(stale, ~F.col("copy_fits")).otherwise(recorded & (F.col("l_version") != F.col("i_version")))
    told = met.withColumns({"stale": stale, "use_copy": copy & ~behind, "use_lock": has & ~stale, "behind": behind})
    source = F.when(F.col("use_copy"), "node_modules").when(F.col("use_lock"), "lockfile").when(guess.isNotNull(), "manifest-range")
    pick = lambda a, b, c: F.when(F.col("use_copy"), a).when(F.col("use_lock"), b).otherwise(c)
    name = pick(F.col("i_name"), F.col("l_name"), F.col("name"))
    version = pick(F.col("i_version"), F.col("l_version"), guess)
    flags = F.array_compact(F.array(F.when(name != F.col("key"), "alias"), F.when(F.col("use_copy") & ~semver.is_stable("i_version"), "prerelease-installed"), F.when(~F.col("use_copy") & ~F.col("use_lock") & guess.isNotNull(), "range-guess")))
    late = F.array_compact(F.array(F.when(F.col("behind"), F.struct(F.lit("node_modules").alias("source"), F.col("i_version").alias("version"))), F.when(F.col("stale") & ~F.col("use_copy"), F.struct(F.concat(F.lit("lockfile:"), "source").alias("source"), F.col("l_version").alias("version")))))
    return told.select(*[c for c in declarations.columns if c != "name"], name.alias("name"), version.alias("version"), source.alias("version_source"), F.coalesce("i_local", F.lit(False)).alias("linked"), flags.alias("flags"), late.alias("out_of_sync"))


def lowest(declared: Column) -> Column:
    """The lowest version that a plain range allows: what its first comparator names, filled with zeros; null if it names none."""
    form = r"^(?:\^|~|>=|=|v)?\s*v?(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(-[0-9A-Za-z.-]+)?"
    first = F.get(F.split(F.trim(declared), r"\s*\|\|\s*"), F.lit(0))
    number = lambda k: F.when(F.regexp_extract(first, form, k).rlike(r"^\d+\z"), F.regexp_extract(first, form, k)).otherwise("0")
    return F.when(semver.is_range(declared) & first.rlike(form), F.concat(number(1), F.lit("."), number(2), F.lit("."), number(3), F.regexp_extract(first, form, 4))).when(F.trim(declared).isin("", "*", "x"), "0.0.0")
