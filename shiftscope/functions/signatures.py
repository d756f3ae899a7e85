"""Signatures as text: types in one spelling, and what a change of parameters means.

Comparisons are columns. `normalized_type` sorts the operands of unions at every depth, which no column expression can;
it is the one Pandas UDF here, over texts of one type each.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Longer texts are named by their hash.
LONGEST = 3000

_TOKEN = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|([A-Za-z_$][\w$]*\.(?=[A-Za-z_$]))|(=>)|([\w$.]+)|(.)""", re.DOTALL)
_LABEL = re.compile(r"""(?:readonly\s+)?(?:[\w$]+|"[^"]*"|'[^']*'|\[[^\]]*\])\??:\s*""")
_OPEN, _CLOSE = {"(": ")", "<": ">", "[": "]", "{": "}"}, {")", ">", "]", "}"}


def _atoms(text: str) -> list[str]:
    """Strings, arrows, words and single marks; qualifiers before a name are left out."""
    return [found[0] for found in _TOKEN.finditer(text) if found[2] is None]


def _sorted(atoms: list[str]) -> str:
    """The text with the operands of each union or intersection in order; a label before them stays where it is."""
    text = "".join(atoms)
    if label := _LABEL.match(text):
        at, n = 0, label.end()
        while n > 0:
            n -= len(atoms[at])
            at += 1
        if n == 0 and at < len(atoms):
            return label[0] + _sorted(atoms[at:])
    # pieces at depth zero: operands between operators, and brackets with what is inside
    depth, start, pieces, operators = 0, 0, [], []
    for i, x in enumerate(atoms):
        if x in _OPEN:
            depth += 1
        elif x in _CLOSE:
            depth -= 1
            if depth < 0:
                return text
        elif depth == 0 and x in "|&" and atoms[i - 1 : i] != [x] and atoms[i + 1 : i + 2] != [x]:
            operators.append(x)
            pieces.append(atoms[start:i])
            start = i + 1
    if depth:
        return text
    if operators and len(set(operators)) == 1:
        operands = [_sorted(_trimmed(p)) for p in (*pieces, atoms[start:])]
        return f" {operators[0]} ".join(sorted(operands))
    out, i = [], 0
    while i < len(atoms):
        if atoms[i] not in _OPEN:
            out.append(atoms[i])
            i += 1
            continue
        end = _matching(atoms, i)
        out.append(atoms[i])
        part: list[str] = []
        depth = 0
        for x in (*atoms[i + 1 : end], None):
            if x is None or (depth == 0 and x in ",;"):
                lead, rest = 0, part
                while lead < len(part) and part[lead].isspace():
                    lead += 1
                tail = len(part)
                while tail > lead and part[tail - 1].isspace():
                    tail -= 1
                out += [*rest[:lead], _sorted(rest[lead:tail]) if tail > lead else "", *rest[tail:], x or ""]
                part = []
                continue
            depth += (x in _OPEN) - (x in _CLOSE)
            part.append(x)
        out.append(atoms[end])
        i = end + 1
    return "".join(out)


def _trimmed(atoms: list[str]) -> list[str]:
    a, b = 0, len(atoms)
    while a < b and atoms[a].isspace():
        a += 1
    while b > a and atoms[b - 1].isspace():
        b -= 1
    return atoms[a:b]


def _matching(atoms: list[str], start: int) -> int:
    depth = 0
    for i in range(start, len(atoms)):
        depth += (atoms[i] in _OPEN) - (atoms[i] in _CLOSE)
        if depth == 0:
            return i
    return len(atoms) - 1


def type_text(text: str | None) -> str | None:
    """One spelling of a type; see normalized_type. Nesting beyond what can be followed leaves the text as it is written."""
    if text is None:
        return None
    plain = "".join(_atoms(re.sub(r'import\("[^"]*"\)\.', "", text)))
    plain = re.sub(r";\s*}", " }", re.sub(r"\s+", " ", plain)).strip()
    try:
        plain = _sorted(_atoms(plain))
    except RecursionError:
        pass
    return f"#{hashlib.sha1(plain.encode()).hexdigest()}" if len(plain) > LONGEST else plain


@pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(type_text)


def normalized_type(text: Column) -> Column:
    """A type's text without qualifiers and import(), single spaces, operands of unions sorted at every depth; null stays null."""
    return _normalized(text)


def signature(type_params: Column, params: Column, returns: Column) -> Column:
    """The text of a signature of normalized types: `<$T0 extends A>(A, ...B[], C?) => R`.

    type_params: array<struct<name, extends>>; params: array<struct<type, rest, optional>>. Parameters' names don't
    count, type parameters are named by their place.
    """
    named = lambda text: F.aggregate(F.transform(type_params, lambda p, i: F.struct(p["name"].alias("name"), i.alias("i"))), text, lambda acc, p: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\w$.])"), F.regexp_replace(p["name"], r"\$", r"\\\$"), F.lit(r"(?![\w$])")), F.concat(F.lit(r"\$T"), p["i"].cast("string"))))
    own = F.transform(type_params, lambda p, i: F.concat(F.lit("$T"), i.cast("string"), F.coalesce(F.concat(F.lit(" extends "), named(p["extends"])), F.lit(""))))
    each = F.transform(params, lambda p: F.concat(F.when(p["rest"], "...").otherwise(""), named(p["type"]), F.when(p["optional"], "?").otherwise("")))
    text = F.concat(F.when(F.size(type_params) > 0, F.concat(F.lit("<"), F.array_join(own, ", "), F.lit(">"))).otherwise(""), F.lit("("), F.array_join(each, ", "), F.lit(") => "), named(returns))
    return F.when(F.length(text) > LONGEST, F.concat(F.lit("#"), F.sha1(text))).otherwise(text)


_ANY = r"(?<![\w$])any(?![\w$])"


def _any_covers(text: Column, other: Column) -> Column:
    """Whether `other` is the text with something in the place of each `any`."""
    parts = F.split(text, _ANY)
    pattern = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1")), r"[\w$.<>\[\], |&]+?")
    return text.rlike(_ANY) & F.rlike(other, F.concat(F.lit("^"), pattern, F.lit(r"\z")))


def same_modulo_any(a: Column, b: Column) -> Column:
    """Whether two lists of signatures, sorted, are alike but for `any` on one side of each pair."""
    x, y = F.sort_array(a), F.sort_array(b)
    alike = F.zip_with(x, y, lambda s, t: F.coalesce(_any_covers(s, t) | _any_covers(t, s), F.lit(False)))
    return (F.size(a) == F.size(b)) & (F.size(a) > 0) & F.forall(alike, lambda ok: ok)


_CALL = r"^(<[^>]*>)?\((.*)\) => (.*)\z"


def _optional(param: Column) -> Column:
    return param.endswith("?") | param.startswith("...")


def appends_optional(old: Column, new: Column) -> Column:
    """Whether a signature only gained optional parameters at its end."""
    part = lambda s, k: F.regexp_extract(s, _CALL, k)
    extra = F.regexp_replace(F.substr(part(new, 2), F.length(part(old, 2)) + 1), r"^,\s*", "")
    same = old.rlike(_CALL) & new.rlike(_CALL) & (part(old, 1) == part(new, 1)) & (part(old, 3) == part(new, 3)) & F.startswith(part(new, 2), part(old, 2))
    return same & (extra != "") & F.forall(F.split(extra, r",\s*"), _optional)


def is_widening(before: Column, after: Column) -> Column:
    """Every earlier signature is still there, or each has one that only gained optional parameters."""
    kept = F.forall(before, lambda x: F.array_contains(after, x))
    return (F.size(before) > 0) & (kept | F.forall(before, lambda x: F.exists(after, lambda y: appends_optional(x, y))))


_ATOM = r"""=>|"[^"]*"|'[^']*'|`[^`]*`|[\s\S]"""


def call_parts(text: Column) -> Column:
    """struct<type_params, params array, returns> of a signature's text, `<$T0>(A, B?) => R`; null of what is no call.

    Java's patterns don't nest, so one fold over brackets, strings and arrows keeps the depth: the parameters end at the bracket that
    closes the first one outside `<>`, whatever functions or objects stand in them or in the result.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("part"), F.lit("").alias("head"), F.lit("").alias("inner"), F.lit("").alias("rest"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["part"] == 0) & (acc["depth"] == 0) & (x == "(")
        closes = (acc["part"] == 1) & (acc["depth"] == 1) & (x == ")")
        depth = acc["depth"] + F.when(x.isin("(", "<", "[", "{"), 1).when(x.isin(")", ">", "]", "}"), -1).otherwise(0)
        comma = (x == ",") & (acc["depth"] == 1)
        return F.struct(
            depth.alias("depth"),
            F.when(opens, 1).when(closes, 2).otherwise(acc["part"]).alias("part"),
            F.when((acc["part"] == 0) & ~opens, F.concat(acc["head"], x)).otherwise(acc["head"]).alias("head"),
            F.when((acc["part"] == 1) & ~closes, F.concat(acc["inner"], F.when(comma, F.lit("\u0000")).otherwise(x))).otherwise(acc["inner"]).alias("inner"),
            F.when(acc["part"] == 2, F.concat(acc["rest"], x)).otherwise(acc["rest"]).alias("rest"),
        )

    def finish(acc: Column) -> Column:
        each = F.transform(F.split(acc["inner"], "\u0000"), lambda p: F.trim(p))
        params = F.when(F.trim(acc["inner"]) == "", F.array().cast("array<string>")).otherwise(each)
        sound = (acc["part"] == 2) & F.startswith(acc["rest"], F.lit(" => ")) & acc["head"].rlike(r"^(<[\s\S]*>)?\z")
        return F.when(sound, F.struct(acc["head"].alias("type_params"), params.alias("params"), F.substr(acc["rest"], F.lit(5)).alias("returns")))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_ATOM), F.lit(0)), start, step, finish)


def parameters(text: Column) -> Column:
    """The parameters of a signature's text, split at commas outside brackets and strings; null of what is no call."""
    return call_parts(text)["params"]


def first_changed_parameter(before: Column, after: Column) -> Column:
    """The place of the first parameter in which overloads differ, compared in order; null where more than that may matter.

    Each overload keeps its type parameters, result and number of parameters, and from the first that differs on all are
    optional on both sides. A call with no more arguments than the place sees what it saw before.
    """
    parts = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), call_parts)
    places = F.zip_with(
        parts(before),
        parts(after),
        lambda a, b: F.struct(
            F.array_position(F.zip_with(a["params"], b["params"], lambda p, q: ~p.eqNullSafe(q)), True).alias("at"),
            ((a["type_params"] == b["type_params"]) & (a["returns"] == b["returns"]) & (F.size(a["params"]) == F.size(b["params"]))).alias("same"),
            a["params"].alias("a"),
            b["params"].alias("b"),
        ),
    )
    rest = lambda x, c: F.forall(F.filter(x[c], lambda p, i: i >= x["at"] - 1), _optional)
    sound = F.forall(places, lambda x: F.coalesce(x["same"] & ((x["at"] == 0) | (rest(x, "a") & rest(x, "b"))), F.lit(False)))
    first = F.array_min(F.transform(F.filter(places, lambda x: x["at"] > 0), lambda x: (x["at"] - 1).cast("int")))
    return F.when((F.size(before) > 0) & (F.size(before) == F.size(after)) & sound, first)
