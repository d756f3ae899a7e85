"""Values made of a package's exports, followed through assignments, callbacks and files, and references attributed by all ways.

Tables (chain as in `chains`):

* imports: file, local, and of a package pkg, prefix, binding (named, default, namespace), imported; of a file target and imported
  ("*" for all);
* assignments: file, pos, into, local, chain, called: `const into = local.chain()`, pos in the order of the file;
* callbacks: file, pos, into, local: a parameter of a function that is handed to a call on local;
* exports: file, exported, local: values that a file hands on under a name; re_exports as in `usage.origins`.

A fact says that a name of a file holds a value of a package: (file, name, pkg), with what made it (binding, imported, prefix,
built, built_called; null for a callback's parameter, whose type no chain tells) and hops, the files between. Of several
ways to one fact that with the least hops counts, then the first in the order of the file (the pass over its lines, then the line). Both
rise along every step, so facts are a least fixed point: each round joins what is new or came earlier with
assignments, callbacks and imports, until nothing does. In a file a value is followed in at most ROUNDS passes over its
lines, and through at most FILES files; facts beyond are kept as `cut` and go no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chains, graphs, usage

ROUNDS, FILES = 3, 3
#: Joins of one fixed point; chains of assignments in the order of their file are a join each.
LONGEST = 256
KEY = ["file", "name", "pkg"]
MADE = ["prefix", "binding", "imported", "built", "built_called"]


def _extended(built: Column, built_called: Column, chain: Column, called: Column) -> list[Column]:
    """built and built_called of a value read further: calling it calls the last name that made it."""
    n = F.size(built)
    last = F.transform(built, lambda s, i: F.struct(s["name"].alias("name"), (s["call"] | ((i == n - 1) & called)).alias("call"), s["construct"].alias("construct"), s["args"].alias("args")))
    return [F.when(built.isNotNull(), F.concat(last, chain)).alias("built"), F.when(built.isNotNull(), built_called | ((n == 0) & called)).alias("built_called")]


#: Where a fact stands among those of its name and package.
PLACE = ["cut", "hops", "round", "phase", "pos"]


def _text() -> Column:
    return F.to_json(F.struct(*MADE)).alias("text")


def _earliest(facts: DataFrame) -> DataFrame:
    """Of each (file, name, pkg) the first fact."""
    rest = [c for c in facts.columns if c not in KEY]
    return facts.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct(*PLACE, _text())).alias("f")).select(*KEY, "f.*")


def handed_on(exports: DataFrame, re_exports: DataFrame) -> DataFrame:
    """target, imported, file, name: the value (file, name) that importing a name of a file gives, through files that hand it on."""
    ends = exports.select("file", F.col("exported").alias("name"), F.col("local").alias("imported"), F.lit(None).cast("string").alias("target"), F.concat(F.lit("\u0000"), "file").alias("pkg"))
    through = usage.origins(re_exports.select("file", "name", "imported", "target", F.lit(None).cast("string").alias("pkg")).filter("target is not null").unionByName(ends))
    return through.select(F.col("file").alias("target"), F.col("name").alias("imported"), F.expr("substring(pkg, 2)").alias("file"), F.col("imported").alias("name"))


def _of_imports(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """rows (file, local, ...) of imported names with the import; those of other names aren't there."""
    return rows.join(imports.select("file", "local", "pkg", "prefix", "binding", "imported", "target"), ["file", "local"])


def derived(imports: DataFrame, assignments: DataFrame, callbacks: DataFrame, exports: DataFrame, re_exports: DataFrame) -> DataFrame:
    """file, name, pkg, hops, prefix, binding, imported, built, built_called, cut: a written table of all facts."""
    imports = graphs.written(imports, "imports")
    names = imports.select("file", "local").distinct()
    steps = assignments.select("file", "pos", "into", "local", F.coalesce("chain", F.array().cast(chains.NONE)).alias("chain"), F.coalesce("called", F.lit(False)).alias("called"), F.lit(0).alias("phase"))
    given = callbacks.select("file", "pos", "into", "local", F.array().cast(chains.NONE).alias("chain"), F.lit(False).alias("called"), F.lit(1).alias("phase"))
    every = steps.unionByName(given)
    every = every.withColumn("chain", F.transform("chain", lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["call"], F.lit(False)).alias("call"), F.coalesce(s["construct"], F.lit(False)).alias("construct"), s["args"].alias("args"))))
    edges = graphs.written(every, "assignments")
    of_names = graphs.written(edges.join(names, ["file", "local"], "left_anti"), "assignments")
    handed = handed_on(exports, re_exports)
    # what a file imports of others' values: (file, name) there, under local or as a member of the namespace local here
    met = _of_imports(edges, imports).filter("pkg is null and target is not null").withColumn("head", F.when(F.col("imported") == "*", F.get("chain", F.lit(0))["name"]).otherwise(F.col("imported")))
    there = handed.select("target", F.col("imported").alias("head"), F.col("file").alias("from_file"), F.col("name").alias("from_name"))
    across = graphs.written(met.join(there, ["target", "head"]).select("from_file", "from_name", "file", "pos", "into", "phase", "chain", "called", (F.col("imported") == "*").alias("space")).distinct(), "imported-values")

    direct = _of_imports(edges, imports).filter("pkg is not null")
    lost = lambda c: F.when(F.col("phase") == 0, c)  # noqa: E731  (a callback's parameter has no chain)
    seeds = direct.select(
        "file", F.col("into").alias("name"), "pkg", F.lit(0).alias("hops"), F.lit(0).alias("round"), "phase", "pos", lost(F.col("prefix")).alias("prefix"), lost(F.col("binding")).alias("binding"),
        lost(F.col("imported")).alias("imported"), lost(F.col("chain")).alias("built"), lost(F.col("called")).alias("built_called"), F.lit(False).alias("cut"), F.lit(None).cast("string").alias("source"),
    )
    seeds = _earliest(seeds)
    columns = seeds.columns
    # columns of a round, the same for all
    later = (F.col("phase") > F.col("f_phase")) | ((F.col("phase") == F.col("f_phase")) & (F.col("pos") > F.col("f_pos")))
    # the first pass reads what imports give; passes over other names come after it, but callbacks are read in it too
    turn = F.when((F.col("f_round") == 0) & (F.col("phase") == 0), 1).otherwise(F.col("f_round") + F.when(later, 0).otherwise(1))
    told = lambda chain, called: [F.when(F.col("phase") == 0, c).alias(n) for c, n in zip(_extended(F.col("built"), F.col("built_called"), chain, called), ("built", "built_called"), strict=True)]
    made = [F.when(F.col("phase") == 0, F.col(c)).alias(c) for c in ("prefix", "binding", "imported")]
    here = [F.col("file"), F.col("into").alias("name"), *map(F.col, ("pkg", "hops")), turn.alias("round"), F.col("phase"), F.col("pos"), *made, *told(F.col("chain"), F.col("called")), (turn > ROUNDS).alias("cut"), F.concat_ws("\u0000", "file", "local").alias("source")]
    n = F.col("hops") + 1
    # a namespace's member is the name that the other file hands on
    tail = F.when(F.col("space"), F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0)))).otherwise(F.col("chain"))
    calls = F.when(F.col("space"), F.coalesce(F.get("chain", F.lit(0))["call"], F.lit(False))).otherwise(F.col("called"))
    there = [F.col("file"), F.col("into").alias("name"), F.col("pkg"), n.alias("hops"), F.lit(0).alias("round"), F.col("phase"), F.col("pos"), *made, *told(tail, calls), (n > FILES).alias("cut"), F.concat_ws("\u0000", "from_file", "from_name").alias("source")]
    rest = [c for c in columns if c not in KEY]
    held = lambda name: [*map(F.col, KEY), F.struct(*rest, _text()).alias(name)]
    place = lambda name: F.struct(*[F.col(f"{name}.{c}") for c in PLACE])
    whole = lambda name: F.struct(*[F.col(f"{name}.{c}") for c in [*PLACE, "text"]])
    # a value whose source was made anew is made anew by the same line
    again = (place("new") == place("old")) & F.col("new.source").eqNullSafe(F.col("old.source")) & (F.col("new.text") != F.col("old.text"))
    better = F.col("new").isNotNull() & (F.col("old").isNull() | (whole("new") < whole("old")) | again)
    after = [*map(F.col, KEY), *[F.when(F.col("fresh"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest], F.col("fresh")]
    facts = graphs.written(seeds.withColumn("fresh", F.lit(True)), "facts")
    for _ in range(LONGEST):
        near = facts.filter("fresh and not cut")
        if near.isEmpty():
            break
        near = near.withColumnsRenamed({"name": "local", "phase": "f_phase", "pos": "f_pos", "round": "f_round"})
        own = near.join(of_names, ["file", "local"]).select(*here)
        far = near.withColumnsRenamed({"file": "from_file", "local": "from_name"}).join(across, ["from_file", "from_name"]).select(*there)
        found = _earliest(own.unionByName(far).select(*columns))
        met = facts.select(*held("old")).join(found.select(*held("new")), KEY, "full").withColumn("fresh", better).select(*after)
        before, facts = facts, graphs.written(met, "facts")
        graphs.dropped(before)
    else:
        raise ValueError(f"values are assigned on in chains of over {LONGEST} names")
    graphs.dropped(imports, edges, of_names, across)
    return facts.drop("fresh")


def attributed(references: DataFrame, imports: DataFrame, origin: DataFrame, handed: DataFrame, facts: DataFrame) -> DataFrame:
    """References (file, line, col, local, chain, called) to packages by every way there is, each with its provenance, least hops first.

    origin: `usage.origins` of what files hand on; handed: `handed_on`; facts: `derived`. Columns: file, line, col, pkg, way (direct,
    forwarded, derived), hops, via (the file that it came through), rank (of a reference's ways to a package), blind
    (derived-escape: too far to say what it is) and what `chains.walk` reads. A derived value that is not read further says nothing.
    """
    none = F.array().cast(chains.NONE)
    rows = references.select("file", "line", "col", "local", F.coalesce("chain", none).alias("chain"), F.coalesce("called", F.lit(False)).alias("called"))
    null = lambda kind: F.lit(None).cast(kind)
    out = ["file", "line", "col", "pkg", "way", "hops", "via", "prefix", "binding", "imported", "called", "chain", "built", "built_called", "cut"]
    met = _of_imports(rows, imports)
    plain = {"built": null(chains.NONE), "built_called": null("boolean"), "cut": F.lit(False), "hops": F.lit(0)}
    direct = met.filter("pkg is not null").withColumns({**plain, "way": F.lit("direct"), "via": null("string")}).select(*out)
    # a namespace of a file: the head of the chain is the name that the file hands on
    space = F.col("imported") == "*"
    head = F.when(space, F.get("chain", F.lit(0))["name"]).otherwise(F.col("imported"))
    rest = F.when(space, F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0)))).otherwise(F.col("chain"))
    calls = F.when(space, F.coalesce(F.get("chain", F.lit(0))["call"], F.lit(False))).otherwise(F.col("called"))
    through = met.filter("pkg is null and target is not null").select("file", "line", "col", F.col("target").alias("via"), head.alias("name"), rest.alias("chain"), calls.alias("called"))
    named = origin.filter(F.col("name") != "*").select(F.col("file").alias("via"), "name", "pkg", F.col("imported").alias("of"))
    binding = F.when(F.col("of") == "*", "namespace").when(F.col("of") == "default", "default").otherwise("named")
    forwarded = through.join(named, ["via", "name"]).withColumns({**plain, "way": F.lit("forwarded"), "binding": binding, "imported": F.when(binding == "named", F.col("of")), "prefix": F.col("pkg")}).select(*out)
    made = facts.select(F.col("file").alias("from_file"), F.col("name").alias("from_name"), "pkg", "hops", "prefix", "binding", "imported", "built", "built_called", "cut")
    far = through.join(handed.select(F.col("target").alias("via"), F.col("imported").alias("name"), F.col("file").alias("from_file"), F.col("name").alias("from_name")), ["via", "name"]).join(made, ["from_file", "from_name"])
    far = far.withColumns({"hops": F.col("hops") + 1, "way": F.lit("derived")}).withColumn("cut", F.col("cut") | (F.col("hops") > FILES)).select(*out)
    local = rows.join(imports.select("file", "local").distinct(), ["file", "local"], "left_anti").withColumnsRenamed({"local": "name"})
    here = local.join(facts, ["file", "name"]).withColumns({"way": F.lit("derived"), "via": null("string")}).select(*out)
    own = far.unionByName(here).filter((F.size("chain") > 0) | F.col("cut")).withColumn("binding", F.coalesce("binding", F.lit("derived")))
    every = direct.unionByName(forwarded).unionByName(own).distinct()
    way = F.array_position(F.array(F.lit("direct"), F.lit("forwarded"), F.lit("derived")), F.col("way"))
    rank = F.row_number().over(Window.partitionBy("file", "line", "col", "pkg").orderBy("hops", way, F.coalesce("via", F.lit("")), F.to_json(F.struct("imported", "built", "chain"))))
    return every.withColumns({"rank": rank, "blind": F.when(F.col("cut"), "derived-escape")}).drop("cut")
