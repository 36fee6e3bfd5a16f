"""Text expressions: Column in, Column out, all of them built-in functions of Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Line ends of the wider convention (P11): also vertical tab, form feed, separators, NEL and the Unicode ones.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e" + chr(0x85) + chr(0x2028) + chr(0x2029) + "]"


def slug(path: Column) -> Column:
    """Last segment, lower case, blanks as hyphens."""
    return F.lower(F.replace(F.element_at(F.split(path, "/"), -1), F.lit(" "), F.lit("-")))


def project_id(path: Column) -> Column:
    """Slug and the first twelve digits of the root's SHA-256."""
    return F.concat(slug(path), F.lit("_"), F.substring(F.sha2(path, 256), 1, 12))


def words(text: Column) -> Column:
    """Runs of three or more ASCII letters of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return word.isin(*fixed.STOP_WORDS)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Suffix with its dot; none for names that only begin with a dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def segments(path: Column) -> Column:
    return F.transform(F.split(path, "/"), F.lower)


def folders(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def has_segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, names)))


def lines(text: Column) -> Column:
    """Lines by the wider convention, no empty one behind a last line end; an empty text has none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def plain_lines(text: Column) -> Column:
    """Lines split at line feeds alone; the empty one behind the last stays."""
    return F.split(text, "\n", -1)


def symbol_on(line: Column, ext: Column) -> Column:
    """P06-P08: "type name" by the first pattern of the suffix that matches the line; null if none does.

    One expression a pattern, each evaluated once and only for lines of its suffix.
    """
    out = F.lit(None).cast("string")
    for patterns, keys in _shared_patterns():
        found = []
        for pattern, kind in patterns:
            name = F.regexp_extract(line, pattern.replace("(?P<", "(?<"), re.compile(pattern).groupindex["name"])
            found.append(F.when(F.contains(line, F.lit(needed_literal(pattern))), F.nullif(F.concat(F.lit(f"{kind} "), name), F.lit(f"{kind} "))))
        out = F.when(ext.isin(*keys), F.coalesce(*found)).otherwise(out)
    return out


def needed_literal(pattern: str) -> str:
    """The longest word outside groups and classes of a pattern, which every match has; a bracket if there is no word.

    A plain search for it spares most lines the pattern.
    """
    flat = re.sub(r"\[[^\]]*\]", " ", pattern)
    flat = re.sub(r"\((?:[^()\\]|\\.)*\)\??", " ", flat)
    words = re.findall(r"[A-Za-z]{2,}", re.sub(r"\\[A-Za-z]", " ", flat))
    return max(words, key=len) if words else "("


def _shared_patterns():
    """Pattern lists with all suffixes that have just these."""
    by: dict[tuple, list[str]] = {}
    for key, patterns in fixed.SYMBOL_PATTERNS.items():
        by.setdefault(tuple(patterns), []).append(key)
    return by.items()


def imports_in(text: Column, ext: Column) -> Column:
    """What a text imports, pattern by pattern, each name once, in order of sight."""
    out = F.array().cast("array<string>")
    for key, patterns in fixed.IMPORT_PATTERNS.items():
        found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]
        out = F.when(ext == key, F.array_distinct(F.concat(*found))).otherwise(out)
    return out


def human_size(size: Column) -> Column:
    """P20: whole bytes, else one decimal, exact halves to the even digit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        one = 1024**k
        rest = F.pmod(size * 10, F.lit(one))
        tenths = ((size * 10 - rest) / F.lit(one)).cast("bigint")
        up = (rest * 2 > one) | ((rest * 2 == one) & (tenths % 2 == 1))
        tenths = tenths + up.cast("bigint")
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= one, shown).otherwise(out)
    return out


def without_comments(text: Column) -> Column:
    """Lines that are neither blank nor begin as a comment."""
    body = lambda x: F.trim(F.regexp_replace(x, r"[\t\r\x0b\x0c]", " "))
    keep = lambda x: (body(x) != "") & ~(body(x).startswith("//") | body(x).startswith("#") | body(x).startswith("*") | body(x).startswith("/*"))
    return F.array_join(F.filter(plain_lines(text), keep), "\n")


def numbered(text: Column) -> Column:
    """Lines with their number in four places."""
    return F.array_join(F.transform(plain_lines(text), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), F.greatest(F.lit(4), F.length((i + 1).cast("string"))), F.lit(" ")), F.lit(" | "), x)), "\n")


def chunk_header(path: Column, first: Column, last: Column, symbol: Column) -> Column:
    """P23."""
    label = F.when(symbol.isNotNull() & (symbol != ""), F.concat(F.lit(" ("), symbol, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("=== "), path, F.lit(" [lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("]"), label, F.lit(" ==="))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def is_aggregate_question(text: Column) -> Column:
    """P24."""
    return any_of(F.lower(text), fixed.AGGREGATE_WORDS)


def is_overview_question(text: Column) -> Column:
    """P27."""
    return any_of(F.lower(text), fixed.OVERVIEW_WORDS)


def category_asked_for(text: Column) -> Column:
    """P25: the category of the first keyword of the list that the text contains."""
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(w)), F.lit(c)) for w, c in fixed.CATEGORY_WORDS))


def is_test_file(path: Column) -> Column:
    """P29."""
    low = F.lower(path)
    return has_segment(path, fixed.TEST_DIRS) | F.contains(F.lower(file_name(path)), F.lit("test_")) | any_of(low, (".test.", ".spec.", "_test."))


def ratio_label(ratio: Column) -> Column:
    """P30."""
    named = F
    for least, label in fixed.RATIO_LABELS:
        named = named.when(ratio >= least, label)
    return named.when(ratio > 0, "Low").otherwise("None detected")


def language(ext: Column) -> Column:
    """Name of the language of a suffix, else the suffix in capitals."""
    bare = F.lower(F.regexp_replace(ext, r"^\.", ""))
    names = F.create_map(*(F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(names, bare), F.upper(bare))


def repository(url: Column, host: str = r"github\.com") -> Column:
    """owner/repo of an address of that host with or without scheme, www, .git and slash, or of a shorthand; else null."""
    bare = F.trim(url)
    full = F.regexp_extract(bare, fixed.REPOSITORY.replace("{host}", host), 1)
    short = F.regexp_extract(bare, fixed.SHORT_REPOSITORY, 1)
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(short, F.lit("")))


def embedding_text(path: Column, symbol: Column, content: Column) -> Column:
    """P38."""
    return F.concat(path, F.lit(" "), F.coalesce(symbol, F.lit("")), F.lit("\n"), F.left(content, F.lit(500)))


def module_of(path: Column) -> Column:
    """First folder, a point for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.split(path, "/")[0]).otherwise(F.lit("."))


def replacement_share(text: Column) -> Column:
    """Share of characters that a lenient decoder put for bytes it couldn't read."""
    bad = F.length(text) - F.length(F.replace(text, F.lit(chr(0xFFFD)), F.lit("")))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(F.lit(0.0))


def fenced(text: Column) -> Column:
    """P19, second way: what stands in the first fenced block."""
    return F.regexp_extract(text, fixed.FENCED, 1)


def confidence(hits: Column, ranked: Column, ratio: Column) -> Column:
    """P31."""
    return (
        F.when((hits > 0) & (ranked >= 1), "high")
        .when((ratio >= fixed.HIGH_RATIO) | ((ranked >= 3) & (ratio >= fixed.HIGH_RATIO_OF_THREE)), "high")
        .when((ratio >= fixed.MEDIUM_RATIO) | (ranked >= 2), "medium")
        .otherwise("low")
    )
