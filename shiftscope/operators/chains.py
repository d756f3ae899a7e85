"""Chains of names walked through a package's types: which exported symbols a reference reaches, step by step.

All chains are walked at once. A state is a chain, the next of its names and a cursor: the members of a namespace, or those of
an instance of a type. A step is one join of the open states with the surface by (pkg, path); a chain that ends or
loses its type leaves the frontier. Equal chains of one package are walked once, however many references share them.

Tables:

* refs: pkg, prefix (the entry's part of a path), binding (named, default, namespace or derived), imported (the name that a
  named one imports), called boolean (the import itself is called), chain array<struct<name, call, construct, args>>; of a derived value
  also built (the chain that made it), built_called, and instance_at (how many of its names tell a type whose instance it
  is, or null); built is null where its making isn't known. Other columns come through.
* symbols: pkg, path, kind, alias_of, returns, instance_of (paths, or null); entries: pkg, prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs

#: Names of a chain that are walked, and aliases that stand for one name.
HOPS, ALIAS_HOPS = 6, 5
SEGMENT = "struct<name:string,call:boolean,construct:boolean,args:int>"
SHAPE = ["pkg", "prefix", "binding", "imported", "called", "chain", "built", "built_called", "instance_at"]
NONE = f"array<{SEGMENT}>"


def is_short_name(name: Column) -> Column:
    """A name so short that an import by it hands on the module itself, unless the import is called."""
    return (name == "default") | (F.length(name) <= 2)


def surface_of(symbols: DataFrame) -> DataFrame:
    """pkg, path, at, kind, returns, instance_of, aliased: each symbol with what its aliases end at, at most ALIAS_HOPS away."""
    own = symbols.select("pkg", "path", F.col("path").alias("at"), "kind", "returns", "instance_of", "alias_of", F.col("alias_of").isNotNull().alias("aliased"))
    if own.filter("aliased").isEmpty():
        return own.drop("alias_of")
    known = symbols.select("pkg", F.col("path").alias("alias_of"), *[F.col(c).alias(f"to_{c}") for c in ("kind", "returns", "instance_of", "alias_of")])
    plain, open_ = own.filter("alias_of is null"), own.filter("alias_of is not null")
    for _ in range(ALIAS_HOPS):
        met = open_.join(known, ["pkg", "alias_of"], "left")
        there = F.col("to_kind").isNotNull()
        following = {c: F.when(there, F.col(f"to_{c}")).otherwise(F.col(c)) for c in ("kind", "returns", "instance_of")}
        open_ = met.withColumns(following | {"at": F.when(there, F.col("alias_of")).otherwise(F.col("at")), "next": F.when(there, F.col("to_alias_of"))}).select(*own.columns[:-2], F.col("next").alias("alias_of"), "aliased")
    return plain.unionByName(open_).drop("alias_of")


def _instance(kind: Column, at: Column, instance_of: Column) -> Column:
    """The type whose members an instance of a symbol has."""
    return F.when(kind == "class", F.coalesce(instance_of, at)).when(kind.isin("interface", "type"), at).otherwise(instance_of)


def _started(shapes: DataFrame, known: DataFrame, entries: DataFrame) -> DataFrame:
    """Shapes with where their walk begins: segs, own (the first of segs that this site writes), type_at, and the cursor."""
    none = F.array().cast(NONE)
    built = F.coalesce("built", none)
    made = F.size(built)
    # calling a built value calls the last name of what built it, or the import itself
    called = F.coalesce("called", F.lit(False))
    last = F.transform(built, lambda s, i: F.struct(s["name"].alias("name"), (F.coalesce(s["call"], F.lit(False)) | ((i == made - 1) & called)).alias("call"), s["construct"].alias("construct"), s["args"].alias("args")))
    derived = F.col("built").isNotNull()
    rows = shapes.withColumns({
        "derived": derived,
        "whole": F.when(derived, F.concat(last, F.coalesce("chain", none))).otherwise(F.coalesce("chain", none)),
        "base_self": F.when(derived, F.coalesce("built_called", F.lit(False))).otherwise(F.lit(False)),
        "self": F.when(derived, F.coalesce("built_called", F.lit(False)) | ((made == 0) & called)).otherwise(called),
        "made": F.when(derived, made).otherwise(0),
    })
    head = F.when(F.col("binding") == "named", F.col("imported")).when(F.col("binding") == "default", F.lit("default"))
    rows = rows.withColumns({"head": head, "module": F.concat("prefix", F.lit(":"))}).withColumn("head_path", F.concat("module", "head"))
    there = known.select("pkg", F.col("path").alias("head_path"), F.lit(True).alias("has_head"))
    module = known.select("pkg", F.col("path").alias("module"), *[F.col(c).alias(f"m_{c}") for c in ("at", "kind", "returns", "instance_of")])
    has = entries.select("pkg", "prefix", F.lit(True).alias("has_entry")).distinct()
    rows = rows.join(has, ["pkg", "prefix"], "left").join(there, ["pkg", "head_path"], "left").join(module, ["pkg", "module"], "left")
    has_head = F.coalesce("has_head", F.lit(False))
    # whether the imported name is a name of the walk: a short one that isn't in the surface stands for the module
    takes = lambda self: F.when(F.col("binding") == "named", has_head | ~(is_short_name(F.col("imported")) & ~self)).when(F.col("binding") == "default", has_head).otherwise(F.lit(False))
    rows = rows.withColumns({"takes": takes(F.col("self")), "base_takes": takes(F.col("base_self"))})
    head_seg = F.struct(F.col("head").alias("name"), F.col("self").alias("call"), F.lit(False).alias("construct"), F.col("self_args").alias("args"))
    segs = F.when(F.col("takes"), F.concat(F.array(head_seg), "whole")).otherwise(F.col("whole"))
    # a default import without such an export, and a namespace, are the module itself; calling them calls it
    starts_called = F.col("self") & ~F.col("takes") & (F.col("binding") != "named")
    base_called = F.col("base_self") & ~F.col("base_takes") & (F.col("binding") != "named")
    rows = rows.withColumns({"segs": segs, "starts_called": starts_called, "base_called": base_called})
    own = F.when(F.col("derived"), F.col("made") + F.when(F.col("base_takes") & F.col("takes"), 1).otherwise(0)).otherwise(0)
    type_at = F.size("segs") - F.size("whole") + F.col("instance_at") - 1
    rows = rows.withColumns({"own": own, "type_at": type_at})
    of_module = F.col("type_at") == -1
    self_type = F.when(F.col("binding") != "named", _instance(F.col("m_kind"), F.col("m_at"), F.col("m_instance_of")))
    missing = ~F.coalesce("has_entry", F.lit(False))
    guess = (F.col("binding") == "derived") & ~F.col("derived")
    lost = (of_module & self_type.isNull()) | (~F.coalesce(of_module, F.lit(False)) & F.col("starts_called") & F.col("m_kind").isNull())
    from_module = F.coalesce(of_module, F.lit(False)) | F.col("starts_called")
    path = F.struct(F.col("module").alias("path"), F.lit(None).cast("int").alias("args"))
    # the module's own path belongs to the making if that called it too
    shown = from_module & ~(F.col("derived") & (F.coalesce(of_module, F.lit(False)) | F.col("base_called")))
    names = lambda c: F.transform(c, lambda s: s["name"])
    stuck = guess | missing | F.coalesce(lost, F.lit(False))
    return rows.select(
        "shape", "pkg", "segs", "own", "type_at", F.lit(0).alias("i"), F.col("starts_called").alias("starts_called"), "derived",
        F.when(from_module, F.when(of_module, self_type).otherwise(F.coalesce("m_returns", "m_instance_of"))).otherwise(F.col("module")).alias("base"),
        F.when(from_module, "type").otherwise("ns").alias("cursor"),
        F.when(~stuck & shown, F.array(path)).otherwise(F.array().cast("array<struct<path:string,args:int>>")).alias("paths"),
        F.when(guess | missing, names(F.col("whole"))).when(stuck, names(F.col("segs"))).otherwise(F.array().cast("array<string>")).alias("unresolved"),
        (missing & ~guess & ~F.col("derived")).alias("missing_head"), (stuck | (F.size("segs") == 0)).alias("done"),
    )


def _step() -> tuple[dict[str, Column], dict[str, Column], list[Column]]:
    """Columns that bring open states one name further, the same for every step: what names the next symbol, what follows from it, the new state."""
    seg = F.get("segs", F.col("i"))
    path = F.when(F.col("cursor") == "type", F.concat("base", F.lit("#"), seg["name"])).when(F.endswith("base", F.lit(":")), F.concat("base", seg["name"])).otherwise(F.concat("base", F.lit("."), seg["name"]))
    there = F.col("kind").isNotNull()
    args = F.when(F.coalesce("seg.call", F.lit(False)), F.col("seg.args"))
    told = lambda p: F.struct(p.alias("path"), args.alias("args"))
    seen = F.when(F.col("aliased") & (F.col("at") != F.col("path")), F.array(told(F.col("path")), told(F.col("at")))).otherwise(F.array(told(F.col("path"))))
    shown = F.col("there") & (F.col("i") >= F.col("own"))
    kind, uses = F.col("kind"), F.coalesce("seg.call", F.lit(False)) | F.coalesce("seg.construct", F.lit(False))
    makes = F.coalesce("seg.construct", F.lit(False)) | (kind == "class")
    a_type = lambda x: F.struct(F.lit("type").alias("cursor"), x.alias("base"))
    a_space = F.struct(F.lit("ns").alias("cursor"), F.col("at").alias("base"))
    after = (
        F.when(F.col("i") == F.col("type_at"), a_type(_instance(kind, F.col("at"), F.col("instance_of"))))
        .when(kind == "namespace", a_space)
        .when(uses, a_type(F.when(makes, F.coalesce("instance_of", "returns")).otherwise(F.col("returns"))))
        .when(kind.isin("class", "enum"), a_space)
        .when(kind.isin("interface", "type"), a_type(F.col("at")))
        .when(F.col("instance_of").isNotNull(), a_type(F.col("instance_of")))
        .when(kind == "variable", a_space)
    )
    rest = lambda i: F.transform(F.slice("segs", i + 1, F.greatest(F.size("segs") - i, F.lit(0))), lambda s: s["name"])
    i = F.col("i") + 1
    ended = i >= F.size("segs")
    lost = ~ended & (F.col("after.base").isNull() | (i >= HOPS))
    state = [
        *map(F.col, ("shape", "pkg", "segs", "own", "type_at")), i.cast("int").alias("i"), F.col("starts_called"), F.col("derived"), F.col("after.base").alias("base"), F.col("after.cursor").alias("cursor"),
        F.when(shown, F.concat("paths", seen)).otherwise(F.col("paths")).alias("paths"),
        F.when(~F.col("there"), rest(F.col("i"))).when(lost, rest(i)).otherwise(F.col("unresolved")).alias("unresolved"),
        F.when(~F.col("there") & (F.col("i") == 0) & ~F.col("starts_called") & ~F.col("derived"), True).otherwise(F.col("missing_head")).alias("missing_head"),
        (~F.col("there") | ended | lost).alias("done"),
    ]
    return {"path": path, "seg": seg}, {"after": after, "there": there}, state


def walk(refs: DataFrame, symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """refs with paths array<struct<path, args>>, unresolved array<string> and missing_head.

    paths: the symbols that a reference's own names reach, in order, an alias and what it stands for both; args: the arguments
    of a call, where known. unresolved: the names behind the point where the type was lost, or behind HOPS of them. missing_head: its
    first name isn't in the surface. Names that made a derived value are walked, but aren't this site's.
    """
    spare = {"built": F.lit(None).cast(NONE), "built_called": F.lit(None).cast("boolean"), "instance_at": F.lit(None).cast("int"), "imported": F.lit(None).cast("string"), "called": F.lit(False), "self_args": F.lit(None).cast("int")}
    own = refs.withColumns({c: v for c, v in spare.items() if c not in refs.columns})
    shape = [*SHAPE, "self_args"]
    # a chain's JSON tells it: nulls and all
    own = graphs.written(own.withColumn("shape", F.sha2(F.to_json(F.struct(*shape), {"ignoreNullFields": "false"}), 256)), "references")
    shapes = own.groupBy("shape").agg(*[F.first(c).alias(c) for c in shape], F.count(F.lit(1)).alias("n"))
    shapes = graphs.written(shapes, "chains")
    known = graphs.written(surface_of(symbols), "surface")
    state = graphs.written(_started(shapes, known, entries), "walk")
    tables, ended = [state], [state.filter("done")]
    open_ = state.filter("not done")
    asked, met, told = _step()
    for _ in range(HOPS):
        if open_.isEmpty():
            break
        state = graphs.written(open_.withColumns(asked).join(known, ["pkg", "path"], "left").withColumns(met).select(*told), "walk")
        tables.append(state)
        ended.append(state.filter("done"))
        open_ = state.filter("not done")
    found = ended[0]
    for some in ended[1:]:
        found = found.unionByName(some)
    facts = graphs.written(found.select("shape", "paths", "unresolved", "missing_head").join(shapes.select("shape", "n"), "shape"), "walked")
    graphs.dropped(*tables, known, shapes)
    return graphs.join_by_share(own, facts, ["shape"]).drop("shape", *[c for c in spare if c not in refs.columns])


def reached(walked: DataFrame) -> DataFrame:
    """pkg, ref, weak_name, args as `surfaces.touched` reads them, with the other columns of walked: a row for each path that is
    reached, and one for each name that is not."""
    others = [c for c in walked.columns if c not in ("paths", "unresolved", "missing_head", "pkg", "args")]
    strong = walked.select("pkg", *others, F.explode("paths").alias("p")).select("pkg", *others, F.col("p.path").alias("ref"), F.lit(None).cast("string").alias("weak_name"), F.col("p.args").alias("args"))
    weak = walked.select("pkg", *others, F.explode("unresolved").alias("weak_name")).select("pkg", *others, F.lit(None).cast("string").alias("ref"), "weak_name", F.lit(None).cast("int").alias("args"))
    return strong.unionByName(weak)
