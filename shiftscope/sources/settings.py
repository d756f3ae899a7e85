"""Settings of a project: path aliases along `extends`, and packages that only settings, style sheets and conventions name.

Files are tables of path and content. Nothing here follows a name by reading files again: aliases, strings and imports
meet folders, files and installed names by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import graphs
from ..operators.usage import normalized, spelled

#: Files that a settings file inherits from, one behind the other.
EXTENDS = 5

# Names of settings files and style sheets, at-rules that import, and frameworks found through files' places.
CONFIG_FILE = r"(?i)(^|/)([^/]*\.config\.[cm]?[jt]s|\.[a-z-]*rc(\.[cm]?[jt]s|\.json|\.ya?ml)?|[a-z-]*rc\.[cm]?js|tsconfig[^/]*\.json|jsconfig\.json|components\.json|turbo\.json|vercel\.json|biome\.jsonc?|renovate\.json5?|\.babelrc|babel\.config\.json|deno\.jsonc?)\z"
MANIFEST = r"(^|/)package\.json\z"
STYLE_FILE = r"(?i)\.(?:css|scss|sass|less|pcss|postcss)\z"
STYLE_IMPORT = r"""@(?:import|plugin|config|source|use|forward|reference)\s+(?:url\()?\s*["']([^"']+)["']"""
CONVENTIONS = ["next", "nuxt", "astro", "gatsby", "@remix-run/dev", "@react-router/dev", "@sveltejs/kit", "@docusaurus/core", "vitepress", "expo-router", "react-scripts", "@angular/core", "@nestjs/core"]

_STRING = r'("(?:[^"\\]|\\.)*")'


def plain_json(text: Column) -> Column:
    """JSON as settings are written, with comments and trailing commas, as JSON."""
    bare = F.regexp_replace(text, rf"(?s){_STRING}|//[^\n]*|/\*.*?\*/", "$1")
    return F.regexp_replace(bare, rf"{_STRING}|,(?=\s*[}}\]])", "$1")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]+\z", "")


def path_settings(documents: DataFrame) -> DataFrame:
    """path, dir, base, paths array<struct<pattern, targets>>, root: what tsconfig and jsconfig files say of paths, along `extends`; only files that say something.

    What a file says itself goes before what it inherits, of several files the last one that says something; at most EXTENDS files are followed, so
    cycles end. root: the folder that targets are written from, that of the file which declares the paths, or its base.
    """
    json = F.from_json(plain_json(F.col("content")), "struct<extends:string,compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>")
    rows = documents.filter(F.col("path").rlike(r"(?i)\.json\z")).select("path", _folder(F.col("path")).alias("dir"), json.alias("j"))
    said = F.col("j.extends")
    named = F.when(F.startswith(said, F.lit("[")), F.from_json(said, "array<string>")).when(said.isNotNull(), F.array(said)).otherwise(F.array().cast("array<string>"))
    at = lambda name: normalized(F.concat_ws("/", "dir", F.when(name.endswith(".json"), name).otherwise(F.concat(name, F.lit(".json")))))
    own_paths = F.transform(F.map_entries("j.compilerOptions.paths"), lambda e: F.struct(e["key"].alias("pattern"), e["value"].alias("targets")))
    base = F.when(F.col("j.compilerOptions.baseUrl").isNotNull(), normalized(F.concat_ws("/", "dir", "j.compilerOptions.baseUrl")))
    own = rows.select("path", "dir", F.transform(F.filter(named, lambda n: F.startswith(n, F.lit("."))), at).alias("extends"), base.alias("base"), own_paths.alias("paths"))
    own = graphs.written(own.withColumn("root", F.when(F.col("paths").isNotNull(), F.col("dir"))), "settings")
    links = own.select("path", F.posexplode("extends").alias("at", "to"))
    told = own.select("path", "base", "paths", "root")
    for _ in range(EXTENDS):
        if links.isEmpty():
            break
        above = told.filter("base is not null or size(paths) > 0").select(F.col("path").alias("to"), F.struct("base", "paths", "root").alias("up"))
        best = links.join(above, "to").groupBy("path").agg(F.max_by("up", "at").alias("up"))
        met = own.join(best, "path", "left")
        told = graphs.written(met.select("path", F.coalesce("base", "up.base").alias("base"), F.coalesce("paths", "up.paths").alias("paths"), F.coalesce("root", "up.root").alias("root")), "settings")
    empty = F.array().cast("array<struct<pattern:string,targets:array<string>>>")
    whole = told.filter("base is not null or size(paths) > 0").join(own.select("path", "dir"), "path")
    return whole.select("path", "dir", "base", F.coalesce("paths", empty).alias("paths"), F.coalesce("base", "root", "dir").alias("root"))


def nearest_settings(files: DataFrame, documents: DataFrame, settings: DataFrame) -> DataFrame:
    """file, base, paths, root: for each file (path) the settings of the nearest folder above it whose tsconfig, or else jsconfig, says something of paths."""
    rank = F.when(F.col("path").rlike(r"(^|/)tsconfig\.json\z"), 0).when(F.col("path").rlike(r"(^|/)jsconfig\.json\z"), 1)
    first = documents.withColumn("rank", rank).filter("rank is not null").select("path", _folder(F.col("path")).alias("dir"), "rank").groupBy("dir").agg(F.min_by("path", "rank").alias("path"))
    there = first.join(settings.drop("dir"), "path").select(F.col("dir").alias("up"), "base", "paths", "root")
    each = files.select(F.col("path").alias("file"), F.explode(paths.folders(F.col("path"))).alias("up"))
    return each.join(there, "up").groupBy("file").agg(F.max_by(F.struct("base", "paths", "root"), F.length("up")).alias("s")).select("file", "s.*")


def aliased(imports: DataFrame, nearest: DataFrame, files: DataFrame, installed: DataFrame) -> DataFrame:
    """file, specifier, target: imports that settings lead to a file of the project.

    The first pattern, and of it the first target, that a file stands for; else the name under the base, unless it is an installed package's.
    A pattern's star takes whatever stands between its two ends; the first star of a target takes that.
    """
    rows = imports.select("file", "specifier").distinct().filter(~F.col("specifier").rlike(r"^\.{1,2}(/|\z)|^node:")).join(nearest, "file")
    star = F.contains("p.pattern", F.lit("*"))
    pre, post = F.substring_index("p.pattern", "*", 1), F.regexp_extract("p.pattern", r"(?s)^[^*]*\*(.*)\z", 1)
    long_enough = F.length("specifier") >= F.length(pre) + F.length(post)
    fits = (star & F.startswith("specifier", pre) & F.endswith("specifier", post) & long_enough) | (~star & (F.col("p.pattern") == F.col("specifier")))
    taken = F.when(star, F.substr("specifier", F.length(pre) + 1, F.length("specifier") - F.length(pre) - F.length(post))).otherwise("")
    matched = rows.select("file", "specifier", "root", F.posexplode("paths").alias("at", "p")).filter(fits).select("file", "specifier", "root", "at", taken.alias("taken"), F.posexplode("p.targets").alias("nth", "to"))
    to = F.when(F.contains("to", F.lit("*")), F.concat(F.substring_index("to", "*", 1), "taken", F.regexp_extract("to", r"(?s)^[^*]*\*(.*)\z", 1))).otherwise(F.col("to"))
    by_pattern = matched.select("file", "specifier", "at", "nth", normalized(F.concat_ws("/", "root", to)).alias("whole"))
    named = paths.package_of(F.col("specifier"))
    free = rows.filter(F.col("base").isNotNull() & ~F.startswith("specifier", F.lit("@")) & ~F.coalesce(F.contains(named, F.lit(".")), F.lit(False)))
    free = free.withColumn("pkg", named).join(installed.select("pkg").distinct(), "pkg", "left_anti")
    by_base = free.select("file", "specifier", F.lit(1 << 30).alias("at"), F.lit(0).alias("nth"), normalized(F.concat_ws("/", "base", "specifier")).alias("whole"))
    each = by_pattern.unionByName(by_base).select("file", "specifier", "at", "nth", F.posexplode(spelled(F.col("whole"))).alias("way", "path"))
    found = each.join(files.select("path"), "path")
    return found.groupBy("file", "specifier").agg(F.min_by("path", F.struct("at", "nth", "way")).alias("target"))


def _lines_before(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("int")


def config_references(strings: DataFrame, documents: DataFrame, names: DataFrame) -> DataFrame:
    """pkg, kind, path, line: packages that a string of a settings file names, itself or a path into it, and where it first stands.

    strings: path, value (`installed.all_strings`, and literals of code); documents: path, content; names: name (as installed or declared), pkg.
    """
    own = strings.filter(F.col("path").rlike(CONFIG_FILE) | F.col("path").rlike(MANIFEST)).select("path", "value", paths.package_of(F.col("value")).alias("name")).distinct()
    met = own.join(names.select("name", "pkg").distinct(), "name").join(documents.select("path", "content"), "path")
    quoted = F.regexp_extract(F.to_json(F.array("value")), r"(?s)^\[(.*)\]\z", 1)
    at = F.instr("content", quoted)
    line = F.when(at > 0, _lines_before(F.substr("content", F.lit(1), at)) + 1).otherwise(1)
    return met.groupBy("pkg", "path").agg(F.min(line).alias("line")).select("pkg", F.lit("config-reference").alias("kind"), "path", "line")


def style_imports(documents: DataFrame, names: DataFrame) -> DataFrame:
    """pkg, kind, path, line: packages that a style sheet imports, each where it does; a text is read once, between its imports."""
    rows = documents.filter(F.col("path").rlike(STYLE_FILE)).select("path", F.split("content", STYLE_IMPORT).alias("between"), F.regexp_extract_all("content", F.lit(STYLE_IMPORT), F.lit(0)).alias("whole"), F.regexp_extract_all("content", F.lit(STYLE_IMPORT), F.lit(1)).alias("said"))
    rows = rows.filter(F.size("said") > 0)
    # lines up to each import: those of the text before it and of the imports before it
    steps = F.transform("said", lambda s, i: F.struct(s.alias("said"), (_lines_before(F.get("between", i)) + F.when(i > 0, _lines_before(F.get("whole", i - 1))).otherwise(0)).alias("n")))
    each = rows.select("path", F.posexplode(steps).alias("at", "s"))
    by = Window.partitionBy("path").orderBy("at")
    spec = F.regexp_replace("s.said", "^~", "")
    told = each.select("path", paths.package_of(spec).alias("name"), (F.sum("s.n").over(by) + 1).cast("int").alias("line"))
    return told.join(names.select("name", "pkg").distinct(), "name").select("pkg", F.lit("css-import").alias("kind"), "path", "line").distinct()


def conventions(installed: DataFrame) -> DataFrame:
    """pkg, kind, path, line: frameworks that find a project's files by their place. installed: pkg, manifest."""
    return installed.filter(F.col("pkg").isin(CONVENTIONS)).groupBy("pkg").agg(F.min("manifest").alias("path")).select("pkg", F.lit("convention-framework").alias("kind"), "path", F.lit(1).alias("line"))
