"""Problem 9: one consistent form for texts that look the same.

For each token the sets of scripts in which its shapes can be spelt are intersected. If a script is left, the whole
token is spelt in it (Latin first), which settles mixed-script and whole-script confusables alike; if none is left the
shapes that several scripts share are spelt in Latin and the rest stays. Around that: canonical composition, ordinary
width, plain blanks, ligatures taken apart, invisible characters dropped.

Kept apart on purpose: case, accents, raised, lowered and enclosed characters, mathematical alphabets, emoji sequences,
joiners between letters of joining scripts, and overrides of direction, which a reader sees.

Defined results: a null text has a null form; empty and blank texts have an empty form. Blanks at line ends are
invisible and go; CRLF and LF are one line end.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, stored

#: Letters of other scripts with the shape of a Latin letter (fixed values, after Unicode's confusables data).
SAME_SHAPE = {
    "Cyrillic": (
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухіѕјһԁԛԝѵҮүӀӏ",
        "ABESIJKMHOPCTYXYGQWaeopcyxisjhdqwvYyIl",
    ),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳριυ", "ABEZHIKMNOPTYXovcjpiu"),
    "Armenian": ("օոսհՍՏ", "onuhUS"),
    "Cherokee": ("ᎪᏴᏟᎬᎻᏆᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEHIJKLMPRSTVWZ"),
    "Coptic": ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
}
#: Signs and Latin letters with the shape of another one (fixed values, after the same data).
SAME_SIGN = {chr(0x251): "a", chr(0x261): "g", chr(0x1C0): "l", chr(0x2215): "/", chr(0x2212): "-"}
#: Tags are invisible but behind a flag, where they say whose flag it is.
TAGS = re.compile("(%s[%s-%s]+%s)|[%s%s-%s]+" % tuple(map(chr, (0x1F3F4, 0xE0020, 0xE007E, 0xE007F, 0xE0001, 0xE0020, 0xE007F))))
#: Accented letters of other scripts whose base has a Latin shape are composed again after the base is exchanged.
BLANKS = "\t" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
LINE_ENDS = "".join(map(chr, (0x85, 0x2028, 0x2029)))
SEEN = "".join(map(chr, (*range(0x202A, 0x202F), *range(0x2066, 0x206A))))  # change the order of what is shown
ZWNJ, ZWJ = chr(0x200C), chr(0x200D)
HYPHENS = chr(0x2010) + chr(0x2011)


@lru_cache(1)
def forms() -> dict[int, str | None]:
    """str.translate table for single characters, made from the Unicode data of this Python."""
    table: dict[int, str | None] = {}
    for code in range(0x80, 0x30000):
        ch = chr(code)
        cat = U.category(ch)
        if cat in ("Cf", "Cc") and ch not in SEEN and ch not in LINE_ENDS and ch not in (ZWNJ, ZWJ):
            table[code] = None
            continue
        tag = U.decomposition(ch).partition(">")[0]
        if not tag.startswith("<"):
            continue
        name = U.name(ch, "")
        if tag in ("<wide", "<narrow", "<initial", "<medial", "<final", "<isolated") or (
            tag == "<compat" and re.search(r"LIGATURE|DIGRAPH|ROMAN NUMERAL|ELLIPSIS|DOT LEADER|KANGXI RADICAL|CJK RADICAL", name)
        ):
            plain = U.normalize("NFKC", ch)
            if " " not in plain:
                table[code] = plain
    table |= {ord(c): " " for c in BLANKS} | {ord(c): "\n" for c in LINE_ENDS} | {ord(c): "-" for c in HYPHENS}
    table |= {c: None for c in range(0x20) if chr(c) not in "\t\n"} | {0x7F: None, 0x34F: None, 0x115F: None, 0x1160: None, 0x3164: None, 0xFFA0: None, 0x180E: None}
    table |= {c: None for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))} | {ord(c): shape for c, shape in SAME_SIGN.items()}
    return table


@lru_cache(1)
def shapes() -> tuple[dict[str, str], dict[str, frozenset[str]], dict[tuple[str, str], str]]:
    """Letter -> its shape (a Latin letter); shape -> scripts that have it; (script, shape) -> letter."""
    shape: dict[str, str] = {}
    scripts: dict[str, set[str]] = {}
    letter: dict[tuple[str, str], str] = {}
    for script, (theirs, latin) in SAME_SHAPE.items():
        for a, b in zip(theirs, latin, strict=True):
            shape[a] = b
            scripts.setdefault(b, {"Latin"}).add(script)
            letter.setdefault((script, b), a)
    return shape, {k: frozenset(v) for k, v in scripts.items()}, letter


@lru_cache(100_000)
def script_of(ch: str) -> str:
    """Script of a letter by its Unicode name; empty for what is common to all scripts."""
    if not ch.isalpha():
        return ""
    word = U.name(ch, "").split(" ")[0]
    return {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "ARMENIAN": "Armenian", "CHEROKEE": "Cherokee", "COPTIC": "Coptic", "LISU": "Lisu"}.get(word, word)


@lru_cache(200_000)
def spelt(token: str) -> str:
    """The token in one consistent spelling."""
    shape, scripts, letter = shapes()
    marks = U.normalize("NFD", token)
    letters = [shape.get(c, c) for c in marks]
    left: frozenset[str] | None = None
    for c in letters:
        own = scripts.get(c) or (frozenset((s,)) if (s := script_of(c)) else None)
        if own:
            left = own if left is None else left & own
    if left and "Latin" not in left:
        script = min(left)
        letters = [letter.get((script, c), c) for c in letters]
    return U.normalize("NFC", "".join(letters))


TOKEN = re.compile(r"[^\W\d_](?:[^\W_]|[%s-%s])*" % (chr(0x300), chr(0x36F)))
JOINERS = re.compile(f"[{ZWNJ}{ZWJ}]+")
TRAILING = re.compile(r" +(?=\n|\Z)")


def _joined(m: re.Match) -> str:
    """Joiners stay where they show: in emoji sequences and between letters of joining scripts."""
    text, a, b = m.string, m.start() - 1, m.end()
    if a < 0 or b >= len(text):
        return ""
    before, after = text[a], text[b]
    if U.category(before) in ("So", "Sk", "Mn") and U.category(after) == "So" and ZWJ in m[0]:
        return ZWJ
    if 0x0590 < ord(before) < 0x1100 and 0x0590 < ord(after) < 0x1100 and script_of(before) not in ("", "HEBREW", "THAI", "GEORGIAN"):
        return m[0][:1]
    return ""


def consistent(text: str | None) -> str | None:
    """The form in which two texts are equal if they look the same."""
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        text = text.translate(forms())
    else:
        text = U.normalize("NFC", U.normalize("NFC", text).translate(forms()))
        if TAGS.search(text):
            text = TAGS.sub(lambda m: m[1] or "", text)
        if ZWNJ in text or ZWJ in text:
            text = U.normalize("NFC", JOINERS.sub(_joined, text))
        text = TOKEN.sub(lambda m: m[0] if m[0].isascii() else spelt(m[0]), text)
    return TRAILING.sub("", text).rstrip("\n ")


def _run(batches: Iterator[pa.RecordBatch], names: list[str], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([part.column(0), *make(part.column(1).to_pylist())], names=names)


def consistent_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): every row's text in its consistent form. Narrow."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        return _run(batches, [key, "form"], lambda texts: [pa.array([consistent(t) for t in texts], pa.string())])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, form string")


def _digests(texts: list[str | None]) -> list[pa.Array]:
    def of(t: str | None) -> bytes | None:
        return None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    made = [consistent(t) for t in texts]
    return [pa.array([of(f) if f and not f.isspace() else None for f in made], pa.binary()), pa.array([of(t) for t in texts], pa.binary())]


def _spellings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, form, same): digests of the form and of the text of each row that shows anything."""

    def run(batches):
        return _run(batches, ["id", "form", "same"], _digests)

    rows = docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, "id bigint, form binary, same binary").where("form is not null").distinct()
    return stored(rows, "forms")  # read several times


def same_looking(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all rows whose texts differ but have one form.

    Only digests are shuffled. The rows of a form that has several spellings are paired block by block, so that no key grows
    with the form. All pairs come out; for the classes behind them see form_classes. Runs once when it is built.
    """
    rows = _spellings(docs, key, text)
    per = rows.groupBy("form").agg(F.count("id").alias("n"), F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").select("form", "n")
    member = rows.join(per, "form").select(F.col("form").alias("text"), F.struct("id", "same").alias("id"), "n").where("id.id is not null")
    own = per.select(F.col("form").alias("a"), F.col("form").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    both = block_pairs(own, member).where("x.same <> y.same and x.id <> y.id")
    return both.select(F.col("x.id").alias("doc_id_a"), F.col("y.id").alias("doc_id_b")).distinct()


def form_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, text_id, spellings): each row that shows anything with the least row of its form, the least row of its
    very text, and the number of different texts of the form. Linear, whatever the number of spellings."""
    rows = _spellings(docs, key, text)
    texts = rows.groupBy("form", "same").agg(F.min("id").alias("text_id"))
    forms = texts.groupBy("form").agg(F.min("text_id").alias("class_id"), F.count("*").alias("spellings"))
    return rows.join(texts, ["form", "same"]).join(forms, "form").select(F.col("id").alias(key), "class_id", "text_id", "spellings")
