"""Chains of names walked through types, values followed through files, and what is attributed to packages by all ways."""

import random

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import chains, graphs, surfaces, usage, values

SYMBOLS = "pkg string, path string, kind string, alias_of string, returns string, instance_of string"
REFS = f"id int, pkg string, prefix string, binding string, imported string, called boolean, chain array<{chains.SEGMENT}>, built array<{chains.SEGMENT}>, built_called boolean, instance_at int"


def seg(text):
    """`name`, `name()` (a call), `name(2)` (a call with so many arguments) or `new name`."""
    new = text.startswith("new ")
    name, _, args = text.removeprefix("new ").partition("(")
    return name, "(" in text, new, int(args[:-1]) if args not in ("", ")") else None


def chain(text):
    return [seg(x) for x in text.split(".")] if text else []


def s(path, kind, returns=None, instance_of=None, alias_of=None):
    return "m", path, kind, alias_of, returns, instance_of


SURFACE = [
    s("m:make", "function", returns="m:Door"), s("m:Door", "class", instance_of="m:Door"), s("m:Door.of", "method", returns="m:Door"), s("m:Door#open", "method", returns="m:Door"), s("m:Door#wood", "property", instance_of="m:Wood"),
    s("m:Wood", "interface"), s("m:Wood#age", "property"), s("m:kit", "namespace"), s("m:kit.tool", "function", returns="m:Wood"), s("m:k2", "namespace", alias_of="m:kit"), s("m:Gate", "class", alias_of="m:Door"), s("m:shade", "variable"),
    s("m:shade.deep", "variable", instance_of="m:Wood"), s("m/sub:default", "function", returns="m:Wood"), s("m/fn:", "function", returns="m:Door"), s("m:lone", "type", alias_of="m:nowhere"), s("m:lone#x", "property"), s("m:Door#loop", "property", instance_of="m:Door"),
]


def ref(i, text, binding="named", imported=None, called=False, prefix="m", built=None, built_called=None, instance_at=None):
    return i, "m", prefix, binding, imported, called, chain(text), None if built is None else chain(built), built_called, instance_at


def walked(spark, *rows):
    entries = spark.createDataFrame([("m", "m"), ("m", "m/sub"), ("m", "m/fn")], "pkg string, prefix string")
    found = chains.walk(spark.createDataFrame(list(rows), REFS), spark.createDataFrame(SURFACE, SYMBOLS), entries)
    return {r.id: ([p.path for p in r.paths], r.unresolved, r.missing_head) for r in found.collect()}, found


def test_walk(spark):
    cases = {
        1: (ref(1, "open().wood.age", imported="make", called=True), (["m:make", "m:Door#open", "m:Door#wood", "m:Wood#age"], [], False)),
        2: (ref(2, "open", imported="Door"), (["m:Door"], ["open"], False)),  # the class itself has no such member
        3: (ref(3, "of().open", imported="Door"), (["m:Door", "m:Door.of", "m:Door#open"], [], False)),
        4: (ref(4, "new Door.wood", binding="namespace"), (["m:Door", "m:Door#wood"], [], False)),
        5: (ref(5, "tool().age", imported="k2"), (["m:k2", "m:kit", "m:kit.tool", "m:Wood#age"], [], False)),
        6: (ref(6, "open()", imported="Gate", called=True), (["m:Gate", "m:Door", "m:Door#open"], [], False)),
        7: (ref(7, "make().wood", imported="m"), (["m:make", "m:Door#wood"], [], False)),  # a short name stands for the module
        8: (ref(8, "age", binding="default", prefix="m/sub", called=True), (["m/sub:default", "m:Wood#age"], [], False)),
        9: (ref(9, "make().open", binding="default"), (["m:make", "m:Door#open"], [], False)),  # no default: the module itself
        10: (ref(10, "open", binding="namespace", prefix="m/fn", called=True), (["m/fn:", "m:Door#open"], [], False)),
        11: (ref(11, "x.y", imported="gone"), ([], ["gone", "x", "y"], True)),
        12: (ref(12, "a.b", binding="namespace", prefix="m/none"), ([], ["a", "b"], True)),
        13: (ref(13, "age.more.still", imported="shade"), (["m:shade"], ["age", "more", "still"], False)),
        14: (ref(14, "deep.age", imported="shade"), (["m:shade", "m:shade.deep", "m:Wood#age"], [], False)),
        15: (ref(15, "x", imported="lone"), (["m:lone", "m:lone#x"], [], False)),
        16: (ref(16, "loop.loop.loop.loop.loop.loop.loop", imported="make", called=True), (["m:make"] + ["m:Door#loop"] * 5, ["loop", "loop"], False)),
        17: (ref(17, "", binding="namespace"), ([], [], False)),
        18: (ref(18, "open.x", binding="derived"), ([], ["open", "x"], False)),
        19: (ref(19, "open()", binding="named", imported="make", built="", built_called=True), (["m:Door#open"], [], False)),
        20: (ref(20, "wood.age", binding="namespace", built="make()", built_called=False), (["m:Door#wood", "m:Wood#age"], [], False)),
        21: (ref(21, "open", binding="named", imported="make", called=True, built="", built_called=False), (["m:Door#open"], [], False)),
        22: (ref(22, "age", binding="namespace", built="make().wood", built_called=False), (["m:Wood#age"], [], False)),
        23: (ref(23, "open", binding="named", imported="Door", built="", built_called=False, instance_at=0), (["m:Door#open"], [], False)),
        24: (ref(24, "age", binding="namespace", built="kit.gone", built_called=False), ([], ["gone", "age"], False)),
        25: (ref(25, "open", binding="namespace", prefix="m/fn", built="", built_called=True), (["m:Door#open"], [], False)),
    }
    found, _ = walked(spark, *[row for row, _ in cases.values()])
    assert found == {i: want for i, (_, want) in cases.items()}


def test_arguments_and_repeats(spark):
    rows = [ref(i, "open(2).wood", imported="make", called=True) for i in range(5)]
    found, table = walked(spark, *rows)
    assert len(found) == 5 and len({str(v) for v in found.values()}) == 1
    assert [p.args for p in table.first().paths] == [None, 2, None]
    reach = chains.reached(table)
    assert reach.count() == 15 and reach.filter("args = 2").count() == 5
    changes = spark.createDataFrame([("m", "m:Door#open", "changed", 2, None), ("m", "m:Door#wood", "removed", None, None), ("m", "m:Wood", "unproven", None, "symbol-cap")], "pkg string, path string, bucket string, from_param int, cause string")
    landed = surfaces.touched(reach, changes, ["id"])
    assert {(r.path, r.bucket, r.strength) for r in landed.collect()} == {("m:Door#wood", "removed", "strong")} and landed.count() == 5
    assert surfaces.in_doubt(reach, changes).count() == 0


def test_a_surface_without_symbols(spark):
    found = chains.walk(spark.createDataFrame([ref(1, "a", imported="b")], REFS), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], "pkg string, prefix string"))
    assert [(r.paths, r.unresolved, r.missing_head) for r in found.collect()] == [([], ["a"], True)]
    none = chains.walk(spark.createDataFrame([], REFS), spark.createDataFrame(SURFACE, SYMBOLS), spark.createDataFrame([("m", "m")], "pkg string, prefix string"))
    assert none.count() == 0


IMPORTS = "file string, local string, pkg string, prefix string, binding string, imported string, target string"
STEPS = f"file string, pos int, into string, local string, chain array<{chains.SEGMENT}>, called boolean"


def shown(built):
    return None if built is None else ".".join(x["name"] + ("()" if x["call"] else "") for x in built)


def tables(spark, imports, steps, callbacks=(), exports=(), re_exports=()):
    return {
        "imports": spark.createDataFrame(list(imports), IMPORTS),
        "assignments": spark.createDataFrame([(f, p, into, local, chain(c), called) for f, p, into, local, c, called in steps], STEPS),
        "callbacks": spark.createDataFrame(list(callbacks), "file string, pos int, into string, local string"),
        "exports": spark.createDataFrame(list(exports), "file string, exported string, local string"),
        "re_exports": spark.createDataFrame(list(re_exports), "file string, name string, imported string, target string"),
    }


def own(file, local="lib", pkg="p", binding="named", imported="make"):
    return file, local, pkg, pkg, binding, imported, None


def other(file, local, target, imported):
    return file, local, None, None, "named", imported, target


def facts(spark, *args, **more):
    found = values.derived(**tables(spark, *args, **more))
    return {(r.file, r.name): (r.hops, r.cut, shown(r.built), r.built_called) for r in found.collect()}


def test_values_in_a_file(spark):
    steps = [("f", 1, "app", "lib", "", True), ("f", 2, "r", "app", "route()", False), ("f", 3, "x", "r", "y", True), ("f", 4, "loop", "loop", "z", False), ("f", 5, "r", "lib", "late", False), ("f", 9, "far", "later", "", False), ("f", 10, "later", "app", "q", False)]
    found = facts(spark, [own("f")], steps, callbacks=[("f", 6, "req", "app"), ("f", 7, "res", "req"), ("f", 8, "mem", "res")])
    assert found == {
        ("f", "app"): (0, False, "", True), ("f", "r"): (0, False, "late", False), ("f", "x"): (0, False, "late().y", False), ("f", "later"): (0, False, "q", True), ("f", "far"): (0, False, "q", True),
        ("f", "req"): (0, False, None, None), ("f", "res"): (0, False, None, None), ("f", "mem"): (0, False, None, None),
    }


def test_passes_over_a_file(spark):
    """Each value is assigned on a line before that of what it is made of: one pass a value, three at most."""
    steps = [("f", 10 - k, f"v{k}", "lib" if k == 0 else f"v{k - 1}", f"n{k}", False) for k in range(6)]
    found = facts(spark, [own("f")], steps)
    assert {name: cut for (_, name), (_, cut, _, _) in found.items()} == {"v0": False, "v1": False, "v2": False, "v3": False, "v4": True}
    assert found["f", "v3"][2] == "n0.n1.n2.n3"
    straight = facts(spark, [own("f")], [("f", k, f"v{k}", "lib" if k == 0 else f"v{k - 1}", "", False) for k in range(9)])
    assert len(straight) == 9 and not any(cut for _, cut, _, _ in straight.values())


def test_values_through_files(spark):
    imports = [own("a"), *[other(f, "x", t, "v") for f, t in zip("bcdef", "abcde", strict=True)], other("n", "ns", "a", "*"), other("s", "x", "star", "v")]
    steps = [("a", 1, "v", "lib", "go()", False)] + [(f, 1, "v", "x", f"m{f}", False) for f in "bcdef"] + [("n", 1, "w", "ns", "v.k", True), ("s", 1, "w", "x", "k", True), ("n", 2, "u", "ns", "none.k", True)]
    exports = [(f, "v", "v") for f in "abcde"]
    found = facts(spark, imports, steps, exports=exports, re_exports=[("star", "*", "*", "a")])
    assert {k: v[:2] for k, v in found.items()} == {("a", "v"): (0, False), ("b", "v"): (1, False), ("c", "v"): (2, False), ("d", "v"): (3, False), ("e", "v"): (4, True), ("n", "w"): (1, False), ("s", "w"): (1, False)}
    assert found["d", "v"][2] == "go().mb.mc.md" and found["n", "w"][2] == "go().k" and found["s", "w"][2] == "go().k"


def by_hand(lines_, imports):
    """One file read as the rule says: what imports give, then three passes over the lines, the first fact of a name and package kept."""
    facts_ = {}
    for into, local, name in lines_:
        if local in imports:
            facts_.setdefault(into, f"{imports[local]}.{name}")
    for _ in range(values.ROUNDS):
        for into, local, name in lines_:
            if local not in imports and local in facts_:
                facts_.setdefault(into, f"{facts_[local]}.{name}")
    return facts_


def test_random_files(spark):
    rnd = random.Random(4)
    files = {f"f{i}": [(f"v{rnd.randrange(6)}", rnd.choice(["lib", *[f"v{k}" for k in range(6)]]), f"n{pos}") for pos in range(rnd.randint(1, 14))] for i in range(40)}
    steps = [(f, pos, into, local, name, False) for f, lines_ in files.items() for pos, (into, local, name) in enumerate(lines_)]
    found = values.derived(**tables(spark, [own(f) for f in files], steps)).filter("not cut").collect()
    assert {(r.file, r.name): "." + shown(r.built) for r in found} == {(f, name): made for f, lines_ in files.items() for name, made in by_hand(lines_, {"lib": ""}).items()}


def test_references_to_packages(spark):
    imports = [own("a"), other("b", "x", "a", "v"), other("b", "t", "proxy", "thing"), other("b", "ns", "proxy", "*"), own("b", "lib2", "q", "namespace", None)]
    steps = [("a", 1, "v", "lib", "", True)]
    t = tables(spark, imports, steps, exports=[("a", "v", "v")])
    found = values.derived(**t)
    proxy = spark.createDataFrame([("proxy", "thing", "real", None, "p"), ("proxy", "all", "*", None, "q")], "file string, name string, imported string, target string, pkg string")
    origin = graphs.written(usage.origins(proxy), "origin")
    rows = [("a", 5, 1, "lib", "", True), ("a", 6, 1, "v", "get()", False), ("a", 7, 1, "v", "", False), ("b", 1, 1, "x", "read", False), ("b", 2, 1, "t", "m", True), ("b", 3, 1, "ns", "thing.m", False), ("b", 4, 1, "lib2", "z()", False), ("b", 5, 1, "local", "z", False), ("b", 6, 1, "ns", "all.k", False)]
    refs = spark.createDataFrame([(f, line, c, local, chain(x), called) for f, line, c, local, x, called in rows], f"file string, line int, col int, local string, chain array<{chains.SEGMENT}>, called boolean")
    out = values.attributed(refs, t["imports"], origin, values.handed_on(t["exports"], t["re_exports"]), found)
    told = {(r.file, r.line): (r.pkg, r.way, r.hops, r.via, r.binding, r.imported, shown(r.chain), shown(r.built), r.rank) for r in out.collect()}
    assert told == {
        ("a", 5): ("p", "direct", 0, None, "named", "make", "", None, 1),
        ("a", 6): ("p", "derived", 0, None, "named", "make", "get()", "", 1),
        ("b", 1): ("p", "derived", 1, "a", "named", "make", "read", "", 1),
        ("b", 2): ("p", "forwarded", 0, "proxy", "named", "real", "m", None, 1),
        ("b", 3): ("p", "forwarded", 0, "proxy", "named", "real", "m", None, 1),
        ("b", 4): ("q", "direct", 0, None, "namespace", None, "z()", None, 1),
        ("b", 6): ("q", "forwarded", 0, "proxy", "namespace", None, "k", None, 1),
    }
    entries = spark.createDataFrame([("p", "p"), ("q", "q")], "pkg string, prefix string")
    surface = spark.createDataFrame([("p", "p:make", "function", None, "p:T", None), ("p", "p:T#get", "method", None, None, None), ("p", "p:T#read", "method", None, None, None)], SYMBOLS)
    reach = {(r.file, r.line): [p.path for p in r.paths] for r in chains.walk(out, surface, entries).collect()}
    assert reach["a", 6] == ["p:T#get"] and reach["b", 1] == ["p:T#read"] and reach["a", 5] == ["p:make"]


def test_too_long_chains_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(values, "LONGEST", 2)
    with pytest.raises(ValueError, match="chains"):
        values.derived(**tables(spark, [own("f")], [("f", k, f"v{k}", "lib" if k == 0 else f"v{k - 1}", "", False) for k in range(9)]))


def test_hot_shapes_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT_ROWS", 2)
    found, _ = walked(spark, *[ref(i, "open().wood", imported="make", called=True) for i in range(20)], ref(99, "x", imported="gone"))
    assert len(found) == 21 and found[3] == (["m:make", "m:Door#open", "m:Door#wood"], [], False) and found[99][2]
    assert F is not None
