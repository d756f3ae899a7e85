"""Change records, package releases and tarballs, read as tables; JSON and Markdown written."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import briefs

#: The record format that is read; others are ignored.
SCHEMA = 1
RECORD = "schema int, entry string, version string, kind string, breaking boolean, subjects array<string>, source string, extractor string, names_api string"


def change_records(spark: SparkSession, folder: str) -> DataFrame:
    """External records: arrays of objects in JSON files; those of another format or without an entry are left out, repeats once."""
    read = spark.read.schema(RECORD).option("multiLine", True).json(folder)
    kept = read.filter((F.col("schema") == SCHEMA) & F.col("entry").isNotNull() & F.col("version").isNotNull())
    return kept.withColumn("subjects", F.array_sort(F.array_distinct(F.coalesce("subjects", F.array().cast("array<string>"))))).dropDuplicates()


def releases(documents: DataFrame) -> DataFrame:
    """pkg, version, published_at, deprecated, integrity, latest of registry documents (content string: JSON)."""
    json = documents.select(F.try_parse_json("content").alias("json"))
    get = lambda path, kind: F.try_variant_get("json", path, kind)
    rows = json.select(get("$.name", "string").alias("pkg"), get("$['dist-tags'].latest", "string").alias("latest"), get("$.time", "map<string,string>").alias("time"), F.explode(get("$.versions", "map<string,variant>")).alias("version", "v"))
    return rows.select("pkg", "version", F.try_to_timestamp(F.col("time")[F.col("version")]).alias("published_at"), F.try_variant_get("v", "$.deprecated", "string").isNotNull().alias("deprecated"), F.try_variant_get("v", "$.dist.integrity", "string").alias("integrity"), "latest")


def tarball_files(tarballs: DataFrame, pattern: str = "", most: int = 2 << 20) -> DataFrame:
    """key, path, content, skipped of the files in gzipped tarballs (key string, content binary).

    The first folder is dropped; paths with `..` are left out. pattern: a regular expression that paths must fit. A file of over
    `most` bytes has no content and the reason in `skipped`, so that nothing vanishes unseen. A tarball that
    can't be read is one row with null path and the reason.
    """
    import re

    fits = re.compile(pattern).search
    schema = pa.schema([("key", pa.string()), ("path", pa.string()), ("content", pa.string()), ("skipped", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data or b""), mode="r:gz") as archive:
                        for member in archive:
                            path = member.name.partition("/")[2]
                            if not member.isfile() or not path or ".." in path.split("/") or not fits(path):
                                continue
                            over = member.size > most
                            rows.append((key, path, None if over else archive.extractfile(member).read().decode("utf-8", "replace"), "too large" if over else None))
                except (tarfile.TarError, OSError, EOFError) as err:
                    rows.append((key, None, None, f"unreadable: {type(err).__name__}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], schema=schema)

    return tarballs.select("key", "content").mapInArrow(read, "key string, path string, content string, skipped string")


def brief_json(packages: DataFrame) -> DataFrame:
    """One row, one JSON object a package: the columns as they are, keys sorted."""
    return packages.select(F.to_json(F.struct(*sorted(packages.columns))).alias("value"))


def brief_markdown(packages: DataFrame) -> DataFrame:
    """line, in order: a table of packages, the worst verdict first. packages: pkg, from, to, verdict, reasons."""
    order = F.when(F.col("verdict") == "blocked", 0).when(F.col("verdict") == "review", 1).otherwise(2)
    head = packages.sparkSession.createDataFrame([(-2, "", "| Package | From | To | Verdict | Why |"), (-1, "", "|---|---|---|---|---|")], "rank int, pkg string, line string")
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("pkg"), cell("from"), cell("to"), F.col("verdict"), F.concat_ws(", ", "reasons")), F.lit(" |"))
    return head.unionByName(packages.select(order.alias("rank"), "pkg", line.alias("line"))).orderBy("rank", "pkg").select("line")


def brief_sections(documents: DataFrame) -> DataFrame:
    """pkg, place, line: a section a package, as Markdown: its head, what is touched, notes by name, notes without one, and its reasons.

    documents: pkg, document (assembly.documents). Sites of a change, and unplaced notes, are shown up to briefs.SHOWN; a line counts the rest.
    """
    most, d = briefs.SHOWN, F.col("document")
    none = F.array().cast("array<string>")
    code = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    sites = lambda xs, n: F.transform(F.slice(F.coalesce(xs, F.array().cast(SITES)), F.lit(1), n), lambda s: F.concat(F.lit("  - "), code(F.concat(s["file"], F.lit(":"), s["line"].cast("string")))))
    head = F.array(F.concat(F.lit("#### "), code(d["name"]), F.lit(" "), d["from"], F.lit(" to "), d["to"]), F.lit(""), F.concat(d["verdict"], F.lit(", notes "), d["notes"]["coverage"], F.lit(", used in "), d["usage"]["files"].cast("string"), F.lit(" files")), F.lit(""))
    touched = F.flatten(F.transform(d["types"]["touched"], lambda t: F.concat(F.array(F.concat(F.lit("- **"), t["change"], F.lit("** "), code(t["path"]), F.when(t["certainty"] == "by-name", " (by name)").otherwise(""))), sites(t["sites"], F.lit(most["sites"])))))
    named = F.flatten(
        F.transform(
            d["notes"]["matched"],
            lambda m: F.concat(
                F.array(F.concat(F.lit("- "), m["version"], F.lit(": "), m["title"], F.when(m["direct"], "").otherwise(" (perhaps)"), F.lit("; names "), F.array_join(F.transform(m["names"], lambda n: code(n["name"])), ", "))),
                sites(F.try_element_at(d["usage"]["sitesByName"], F.get(m["names"], F.lit(0))["name"]), F.when(m["direct"], most["examples"]).otherwise(1)),
            ),
        )
    )
    loose = lambda xs, said: F.transform(xs, lambda e: F.concat(F.lit("- "), e["version"], F.lit(": "), e["title"], F.lit(f" ({said})")))
    changes = d["notes"]["changesWithoutApi"]
    over = F.size(changes) - most["unplaced"]
    rest = F.when(over > 0, F.array(F.concat(F.lit("- and "), over.cast("string"), F.lit(" more that no name ties to the code")))).otherwise(none)
    why = F.array(F.lit(""), F.concat(F.lit("<sub>"), F.array_join(F.transform(d["reasons"], lambda r: F.concat_ws(": ", r["code"], F.nullif(r["detail"], F.lit("")))), ", "), F.lit("</sub>")), F.lit(""))
    lines_ = F.concat(head, touched, named, loose(d["notes"]["breakingWithoutApi"], "breaking, names no API"), loose(F.slice(changes, 1, most["unplaced"]), "no name ties it to the code"), rest, why)
    return documents.select("pkg", F.posexplode(lines_).alias("place", "line"))


SITES = "array<struct<file:string,line:bigint,column:bigint,typeOnly:boolean,code:string,via:array<string>>>"


#: Bytes of a source file that is read, and characters of a line that mark what a tool wrote.
LARGEST, LONG_LINE = 1_500_000, 1000


def source_blocks(files: DataFrame) -> DataFrame:
    """path, skipped, block, kind, line_offset, text: the scripts of source files, those of components by their tags.

    files: path, content. A file that is too large or looks generated is one row with the reason; kind is ts, tsx, js or jsx.
    """
    own = files.filter(F.col("path").rlike(r"(?i)\.(?:[cm]?[jt]sx?|vue|svelte|astro)\z"))
    split = F.split("content", "\n")
    long = F.exists(split, lambda x: F.length(x) > LONG_LINE) & (F.length("content") >= 5000) & (F.length("content") / F.size(split) > 300)
    skipped = F.when(F.octet_length("content") > LARGEST, "too-large").when(long, "generated")
    lower = F.lower("path")
    component, astro = lower.rlike(r"\.(vue|svelte)\z"), lower.endswith(".astro")
    tags = F.regexp_extract_all("content", F.lit(r"(?i)<script\b[^>]*>[\s\S]*?</script>"), F.lit(0))
    lines_in = lambda text: F.size(F.split(text, "\n")) - 1

    def placed(tags: Column) -> Column:
        """Each tag with the number of lines before its text: what came before it is what is left of the file, tag by tag."""
        step = lambda acc, tag: F.struct(
            (acc["at"] + F.instr(F.substr(F.col("content"), acc["at"] + 1), tag) - 1 + F.length(tag)).cast("int").alias("at"),
            F.array_append(acc["out"], F.struct(tag.alias("tag"), (acc["at"] + F.instr(F.substr(F.col("content"), acc["at"] + 1), tag) - 1).cast("int").alias("start"))).alias("out"),
        )
        return F.aggregate(tags, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<tag:string,start:int>>").alias("out")), step)["out"]

    open_tag = lambda tag: F.regexp_extract(tag, r"^(<[^>]*>)", 1)
    of_tag = lambda x: F.struct(
        F.when(astro | open_tag(x["tag"]).rlike(r"(?i)\blang\s*=\s*[\"\']?(ts|tsx)"), "ts").otherwise("js").alias("kind"),
        lines_in(F.concat(F.substr(F.col("content"), F.lit(1), x["start"]), open_tag(x["tag"]))).alias("line_offset"),
        F.regexp_extract(x["tag"], r"(?i)^<[^>]*>([\s\S]*?)</script>\z", 1).alias("text"),
    )
    front = F.regexp_extract("content", r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    matter = F.when(astro & F.col("content").rlike(r"^---\r?\n[\s\S]*?\r?\n---"), F.array(F.struct(F.lit("ts").alias("kind"), F.lit(1).alias("line_offset"), front.alias("text")))).otherwise(F.array().cast("array<struct<kind:string,line_offset:int,text:string>>"))
    kind = F.when(lower.rlike(r"\.[cm]?tsx\z"), "tsx").when(lower.rlike(r"\.[cm]?ts\z"), "ts").when(lower.endswith(".jsx"), "jsx").otherwise("js")
    whole = F.array(F.struct(kind.alias("kind"), F.lit(0).alias("line_offset"), F.col("content").alias("text")))
    blocks = F.when(component | astro, F.concat(matter, F.transform(placed(tags), of_tag))).otherwise(whole)
    read = own.withColumn("skipped", skipped)
    told = read.filter("skipped is null").select("path", F.lit(None).cast("string").alias("skipped"), F.posexplode(blocks).alias("block", "b")).select("path", "skipped", "block", "b.kind", "b.line_offset", "b.text")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("block", "int"), ("kind", "string"), ("line_offset", "int"), ("text", "string"))]
    return told.unionByName(read.filter("skipped is not null").select("path", "skipped", *none))


def verified(tarballs: DataFrame, integrity: DataFrame) -> DataFrame:
    """key, content, reason of tarballs (key, content) held against integrity (key, integrity); content that isn't what it should be goes.

    reason: `integrity-mismatch`, or `unchecked` where no hash is known; null for what fits.
    """
    fits = numbers.fits_integrity(F.col("content"), F.col("integrity"))
    met = tarballs.select("key", "content").join(integrity.select("key", "integrity"), "key", "left").withColumn("fits", fits)
    reason = F.when(F.col("fits").isNull(), "unchecked").when(~F.col("fits"), "integrity-mismatch")
    return met.select("key", F.when(F.coalesce("fits", F.lit(True)), F.col("content")).alias("content"), reason.alias("reason"))


#: A mined case, as it is kept: what an upgrade changed, and which lines its fix took out.
CASE = (
    "id string, repo string, pr int, base string, split string, packages array<struct<name:string,from:string,to:string>>, "
    "expected array<struct<file:string,line:int,text:string,imports:array<string>>>, added array<struct<file:string,line:int,text:string>>, "
    "labels struct<check:string,testsOnly:boolean,expectedReformatShare:double>"
)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Case files of a folder, one object each, by id; files that aren't such objects are left out."""
    read = spark.read.schema(CASE).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return read.filter("id is not null").orderBy("id")


def write_objects(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, one object each, written to a folder as a whole: none of it is there if the job fails."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "true").json(folder)


def upgrade_rows(upgrades: DataFrame) -> DataFrame:
    """Past upgrades as the rows that are kept of them: what was decided, and what came after.

    upgrades: repo, commit, date, subject, pkg, from, to, bump, verdict, reasons, surface, changes, touched, notes, direct,
    possibly, adapted, follow_ups; a package without a verdict was not analysed.
    """
    state = F.when(F.col("surface") == "computed", F.concat(F.lit("computed "), F.coalesce("changes", F.lit(0)).cast("string"))).otherwise(F.coalesce("surface", F.lit("")))
    none = F.array().cast("array<string>")
    return upgrades.select(
        "repo", F.substring("commit", 1, 8).alias("commit"), F.substring(F.col("date").cast("string"), 1, 10).alias("date"), F.substring("subject", 1, 100).alias("subject"), "pkg", "from", "to", F.coalesce("bump", F.lit("?")).alias("bump"),
        F.coalesce("verdict", F.lit("not-analysed")).alias("verdict"), F.coalesce("reasons", none).alias("reasons"), state.alias("surface"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("touched", "direct", "possibly")], F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("adapted", none).alias("adapted"), F.coalesce("follow_ups", none).alias("followUps"), F.when(F.col("verdict").isNull(), "no brief").alias("error"),
    )
