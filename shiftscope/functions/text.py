"""Text of release notes and code lines, as columns.

Patterns hold in Java's dialect: `\\z` is the end of text, and white space is the class SPACE, which also has the
spaces beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s   -     　﻿]"

#: What isn't white space.
WORD = "[^" + SPACE[1:]

# Patterns by which an entry's kind is told, matched without case. A word's border is one between ASCII
# word characters and others, which Java's \b is not.
NOISE = r"(?i)^(ci|chore|test|tests|docs|doc|build|style|refactor|perf\(bench\)|release|revert)(\([^)]*\))?!?:|^(deps?|dependencies)(\([^)]*\))?:|^bump\s+\S+\s+from\s|^merge (pull request|branch)|^update dependency(?!\w)|^v?\d+\.\d+\.\d+\z"
HOUSEKEEPING = (
    r"(?i)^\w+\((types?|typings?|typescript|docs?|readme|ci|tests?|deps?|deps-dev|build|release|lint|examples?|website)\)!?:|^(readme|internal|release|examples?|website)\s*:"
    r"|^\[(meta|actions|dev deps|deps|tests?|docs?|readme|ci|refactor|robustness)\]|^updated? dependencies(?!\w)|^(special )?thanks(?!\w)|^kudos(?!\w)|^full changelog(?!\w)|^no significant changes(?!\w)"
    r"|^new contributors?(?!\w)|^(commits|contributors)\z|^(upgrade|update|bump)(?!\w).*(?<!\w)(dev-?dependenc\w*|version)(?!\w)|^(upgrade|update|bump)\s+\S+\s+(from|to)\s+v?[\^~]?\d"
)
PROJECT_WORK = r"(?i)(?<!\w)(linter|lint fixes|spelling|typos?|test suite|tests? for|in tests|ci|dtslint|package manager|readme|documentation|jsdoc)(?!\w)"
TYPES_ONLY = r"(?i)^(typescript|types?|typings?)\s*:|^(improve|update|fix)\s+(the\s+)?(typing|typings|types|type definitions?)(?!\w)|(?<!\w)index\.d\.ts(?!\w)"
ADDITION_TITLE = r"(?i)^(feat|feature|perf)(\([^)]*\))?!?:|^(add|adds|added|new|support|supports|introduce|introduces|expose|exposes|allow|allows)(?!\w)"
ADDITION_HEADING = r"(?i)feature|added|(?<!\w)new(?!\w)|performance|(?<!\w)perf(?!\w)"
INSTALL_COMMAND = r"(?m)^\s*(npm|pnpm|yarn|bun|npx)\s+(install|add|i)(?!\w)"
REFERENCE = r"(?i)(?<!\w)(migration guide|upgrade guide|blog post|announcement|release notes|changelog)(?!\w)"
LIST_HEADING = r"(?i)^(commits|contributors|new contributors)\z"
BREAKING_HEADING = r"(?i)(?<!non[- ])breaking|⚠️|:warning:|major changes"
BREAKING_TITLE = r"(?i)^\s*(\*{1,2}|_{1,2}|\[|\()?\s*(⚠️|:warning:|breaking|💥|:boom:)|BREAKING CHANGE"
TAGS = r"(?i)</?(details|summary|p|div|br|sup|sub|b|i|em|strong|span|a|samp)(?!\w)[^>]*>"
CALL_SHAPED = r"(?i)[\w$]\(\)|\.[a-z]\w*\("

#: Texts of an entry by place: kind is title, prose, inline-code or code-block.
REGIONS = "array<struct<kind:string,text:string>>"


#: White space runs that are no single plain space: all that has to be rewritten.
_RUNS = f"{SPACE}{{2,}}|[{SPACE[1:-1]}&&[^ ]]"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def _where(text: Column, mark: str, changed: Column) -> Column:
    """changed where a text has the mark without which nothing changes: a search for it is cheaper than a pattern over all characters."""
    return F.when(F.contains(text, F.lit(mark)), changed).otherwise(text)


def prepared(markdown: Column) -> Column:
    """A Markdown body without comments and images, tags as spaces, addresses of pull requests as #n; line by line as it was."""
    out = F.regexp_replace(markdown, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"https?://github\.com/[\w.-]+/[\w.-]+/(?:pull|issues)/(\d+)", "#$1")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?i)<img(?!\w)[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(out, TAGS, " "), "&nbsp;", " ")


def cleaned(text: Column) -> Column:
    """A line's words: links as their labels, no addresses, single spaces."""
    out = _where(text, "](", F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"))
    out = _where(out, "][", F.regexp_replace(out, r"\[([^\]]+)\]\[[^\]]*\]", "$1"))
    return squeezed(_where(out, "://", F.regexp_replace(out, f"https?://{WORD}+", "")))


def first_sentence(text: Column, least: int = 20, most: int = 160) -> Column:
    """Of the cleaned text, what ends with the first end of a sentence behind `least` characters, else the first `most` characters."""
    plain = cleaned(text)
    found = F.regexp_extract(plain, rf"^(.{{{least},{most}}}?[.!?])( |\z)", 1)
    return F.when(found != "", found).otherwise(F.substring(plain, 1, most))


def first_words(text: Column, most: int = 40) -> Column:
    """The start of a line without its marks."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[`~]", ""), f"^{SPACE}+|{SPACE}+\\z", ""), 1, most)


def normalized_title(title: Column) -> Column:
    """Without marks of emphasis, code and warning, in lower case."""
    return F.lower(squeezed(F.regexp_replace(title, "[`*_]|⚠️?", "")))


def starts_with_title(title: Column, heading: Column) -> Column:
    """Whether a normalized title is a heading, or begins with it and a separator."""
    return (title == heading) | (F.startswith(title, heading) & F.substr(title, F.length(heading) + 1, F.lit(1)).rlike("^[\\s—–:(-]"))


def plain_words(text: Column) -> Column:
    return F.lower(squeezed(F.regexp_replace(text, "[`*_]", "")))


def references(text: Column) -> Column:
    """Numbers written as #n, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w/])(#\d{1,7})(?!\w)"), F.lit(1)))


def code_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1))


def is_code_shaped(name: Column) -> Column:
    """A name that no plain word looks like: a capital, digit, _ or $ after its first letter, or 12 letters and more."""
    return F.substring(name, 2, 1 << 20).rlike("[A-Z_$0-9]") | (F.length(name) >= 12)


def text_regions(text: Column, kind: str) -> Column:
    """A line's parts: its code spans, and what lies between them as `kind`."""
    parts = F.regexp_extract_all(text, F.lit(r"`[^`]+`|(?:(?!`[^`]+`)[\s\S])+"), F.lit(0))
    is_code = lambda p: p.startswith("`") & p.endswith("`") & (F.length(p) > 1)
    region = lambda p: F.struct(F.when(is_code(p), "inline-code").otherwise(kind).alias("kind"), F.when(is_code(p), F.substr(p, F.lit(2), F.length(p) - 2)).otherwise(p).alias("text"))
    return F.transform(F.filter(parts, lambda p: is_code(p) | p.rlike(WORD)), region)


def bare_title(title: Column) -> Column:
    """A title as a commit tool writes it: no code marks, hash or numbers before it, a bold scope as a scope."""
    out = F.regexp_replace(title, "`", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^[0-9a-f]{7,40}\s+", ""), r"^(?:#\d+\s+)+", "")
    out = F.regexp_replace(out, r"^\*\*([^*]+?):?\*\*:?\s*", "$1: ")
    return F.trim(F.regexp_replace(out, r"(?i)^backport:\s*", ""))


def _is_code(region: Column) -> Column:
    return region["kind"].isin("inline-code", "code-block")


def is_breaking(title: Column, heading_path: Column) -> Column:
    return title.rlike(BREAKING_TITLE) | F.exists(heading_path, lambda h: h.rlike(BREAKING_HEADING))


def is_contentless(whole: Column, regions: Column) -> Column:
    """Fewer than two words beside addresses, numbers and hashes, and no code."""
    left = F.regexp_replace(F.regexp_replace(whole, f"https?://{WORD}+", ""), r"(?<![\w/])#\d+(?!\w)|(?<!\w)[0-9a-f]{7,40}(?!\w)", "")
    return ~F.exists(regions, _is_code) & (F.size(F.regexp_extract_all(left, F.lit("[A-Za-z]{2,}"), F.lit(0))) < 2)


def entry_kind(title: Column, whole: Column, regions: Column, heading_path: Column, intro: Column) -> Column:
    """housekeeping, types, intro, reference, addition or change; the first rule that fits.

    whole: the title and all lines of the entry; intro: whether it stands before what a release lists.
    """
    bare = bare_title(title)
    label = F.try_element_at(heading_path, F.lit(-1))
    # an item under a label reads with it
    labelled = F.when(F.coalesce(label, F.lit("")) != "", F.concat(bare_title(label), F.lit(": "), bare)).otherwise(bare)
    names_code = F.exists(regions, lambda r: (r["kind"] == "inline-code") | ((r["kind"] == "code-block") & ~r["text"].rlike(INSTALL_COMMAND)))
    either = lambda *patterns: F.lit(False) if not patterns else bare.rlike(patterns[0]) | labelled.rlike(patterns[0]) | either(*patterns[1:])
    listed = F.exists(heading_path, lambda h: F.trim(h).rlike(LIST_HEADING))
    return (
        F.when(either(NOISE, HOUSEKEEPING) | is_contentless(whole, regions) | listed | (~names_code & bare.rlike(PROJECT_WORK)), "housekeeping")
        .when(either(TYPES_ONLY), "types")
        .when(intro & ~names_code, "intro")
        .when(~names_code & (F.length(whole) < 160) & whole.rlike(REFERENCE), "reference")
        .when(bare.rlike(ADDITION_TITLE) | F.exists(heading_path, lambda h: h.rlike(ADDITION_HEADING)), "addition")
        .otherwise("change")
    )


def _scope(title: Column) -> Column:
    pattern = r"^(?:[a-z]+\(([\w$./-]+)\)!?|([\w$]+)):\s"
    found = F.concat(F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 2))
    return F.when(found != "", found)


def commit_scope(title: Column) -> Column:
    """`parser` of "fix(parser): ..." and of "parser: ...", a hash and numbers before it left out; null without one."""
    return _scope(F.regexp_replace(F.regexp_replace(title, r"^[0-9a-f]{7,40}\s+", ""), r"^(?:#\d+\s+)+", ""))


def headline(regions: Column) -> Column:
    """The regions before the first prose or example."""
    numbered = F.transform(regions, lambda r, i: F.when(r["kind"].isin("prose", "code-block"), i))
    end = F.array_min(numbered)
    return F.when(end.isNull(), regions).otherwise(F.slice(regions, F.lit(1), end))


def names_api(regions: Column) -> Column:
    """Where an entry names an API: headline, text or none."""
    says = lambda r: (r["kind"] == "inline-code") | r["text"].rlike(CALL_SHAPED)
    return F.when(F.exists(headline(regions), says), "headline").when(F.exists(regions, lambda r: r["kind"].isin("title", "inline-code") & says(r)), "text").otherwise("none")


def names_another_api(title: Column, regions: Column, scope: Column) -> Column:
    """Whether a title says which API changed, so that its scope is only where the commit was made."""
    rest = F.regexp_replace(F.regexp_replace(title, r"^[0-9a-f]{7,40}\s+", ""), r"^(?:#\d+\s+)+", "")
    for pattern in (r"^[^:]*:\s", r"(?<!\w)by @\S+.*\z", r"@\S+", r"#\d+", r"\([0-9a-f]{5,}\)"):
        rest = F.regexp_replace(rest, pattern, "")
    code = F.exists(headline(regions), lambda r: (r["kind"] == "inline-code") & ~r["text"].rlike(r"^\s*(?:[0-9a-f]{7,40}|#\d+)\s*\z"))
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))
    named = F.exists(words, lambda w: (w != scope) & is_code_shaped(w) & ~w.rlike(r"^([A-Z]+|[A-Z][a-z]+)\z"))
    return rest.rlike(CALL_SHAPED) | code | named


def code_names(title: Column, regions: Column) -> Column:
    """Names that a note writes as code, of three letters and more, sorted: identifiers in code, words that look like code, the title's scope."""
    ids = lambda text: F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))
    in_code = F.flatten(F.transform(F.filter(regions, _is_code), lambda r: ids(r["text"])))
    words = F.flatten(F.transform(F.concat(F.array(title), F.transform(regions, lambda r: r["text"])), ids))
    shaped = F.filter(words, lambda w: w.rlike(r"[a-z][A-Z]|[_$]|\d|^[A-Z][a-z]+[A-Z]"))
    own = _scope(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, "`", ""), r"^[0-9a-f]{7,40}\s+", ""), r"^(?:#\d+\s+)+", ""), r"^\*\*([^*]+?):?\*\*:?\s*", "$1: "))
    scope = F.regexp_extract(own, r"([^./]*)\z", 1)
    every = F.concat(in_code, shaped, F.when(own.isNotNull(), F.array(scope)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(every, lambda w: F.length(w) >= 3)))


def option_candidates(region: Column) -> Column:
    """Names that a region may name as options: code-shaped words, a whole code span or the start of its path, headers in camel case; none of an example."""
    text, none = region["text"], F.array().cast("array<string>")
    words = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![\w$-])[\w$]+(?![\w$-])"), F.lit(0)), is_code_shaped)
    span = F.regexp_extract(text, r"^\s*\{?\s*([\w$]+)\s*(?:[?:=].*)?\}?\s*\z", 1)
    nested = F.regexp_extract(text, r"^\s*([\w$]+)(?:\.[\w$]+)+\s*\z", 1)
    spans = F.when(region["kind"] == "inline-code", F.array(span, nested)).otherwise(none)
    capital = lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)))
    headers = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+"), F.lit(0)), lambda h: F.array_join(F.transform(F.split(F.lower(h), "-"), capital), ""))
    return F.when(region["kind"] == "code-block", none).otherwise(F.array_distinct(F.filter(F.concat(words, spans, headers), lambda x: x != "")))


def layout_free(line: Column) -> Column:
    """A code line without what formatters change: white space, commas and semicolons, the kind of quotes, parentheses about a lone parameter."""
    out = F.regexp_replace(F.regexp_replace(line, f"{SPACE}+", ""), "[,;]", "")
    return F.regexp_replace(F.translate(out, "'`", '""'), r"\(([A-Za-z_$][\w$]*)\)=>", "$1=>")


def is_meaningful(line: Column) -> Column:
    """Lines with a letter, digit, _ or $ that aren't comments."""
    return line.rlike(r"[A-Za-z0-9_$]") & ~line.rlike(f"^{SPACE}*(//|/\\*|\\*|<!--)")


def imports_package(source: Column, pkg: Column) -> Column:
    """Whether a file's text imports a package or a path of it, in any of the forms."""
    name = F.regexp_replace(pkg, r"([.*+?^${}()|\[\]\\/])", r"\\$1")
    return F.rlike(source, F.concat(F.lit(r"""(?:from\s*|require\(\s*|import\(\s*|import\s+)["']"""), name, F.lit(r"""(?:/[^"']*)?["']""")))


def bracketed_plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def name_list(names: Column, most: int = 4) -> Column:
    """The first names, then how many more there are."""
    more = F.size(names) - most
    return F.concat(F.concat_ws(", ", F.slice(names, 1, most)), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
