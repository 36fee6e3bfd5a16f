"""Problem 2: files that nobody of the project wrote by hand.

A multi-pattern automaton looks for generation and third-party notices in the comments at the head of a file; path rules
know vendored folders, lock files and generator suffixes; the text tells minified code, data saved as code, parser tables
and runs of numbered accessors. Copies of third-party files that carry no notice and lie anywhere are found by a
similarity join (five-word shingles, Jaccard 0.8 or more) of all texts with those of vendored files: an exact prefix
filter proposes pairs, the whole shingle sets decide, and equal texts count as one.

Defined results: files without a text are judged by their path; keys that are not in files don't come out; repeated scans
of a file count once; extension is not needed, the suffix of rel_path counts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import file_texts, most_frequent, possibly_in, stored

SHINGLE, SIMILAR = 5, 0.8

#: Notices of generators and of third parties, lower case (fixed values); they count at the head of a comment line.
GENERATED = (
    "<auto-generated", "autogenerated", "auto-generated", "auto generated", "code generated by", "code generated from", "automatically generated", "automatically produced",
    "automatically created", "automatisch erzeugt", "automatisch generiert", "generado autom", "généré autom", "machine written", "machine-written", "machine generated",
    "machine-generated", "@generated", "generated by", "generated from", "generated with", "generated code", "generated file", "regenerate with", "this file was generated", "this file is generated",
    "this file was automatically", "this file is automatically", "this code was generated", "do not edit this file", "do not modify this file",
)
THIRD_PARTY = (
    "third-party component", "third party component", "@license", "@preserve", "released under the", "licensed under the mit", "copied verbatim from", "vendored from", "vendored copy",
    "copied from", "adapted from upstream", "upstream: http", "keep in sync with upstream", "local patches are not allowed", "contributors. all rights", "copyright (c) the ",
)
BY_HAND = re.compile(r"edit freely|by hand(?<!modify by hand)(?<!edit by hand)|hand-written|handwritten|maintained manually")
AT_HEAD = re.compile(r"^[\s/*#;!\-<\"'%(]*(?:note|warning|notice|attention)?[:\s]*")
VENDOR_PATH = re.compile(r"(?:^|/)(?:vendor|vendors|node_modules|third[_-]?party|thirdparty|external|externals|deps|bower_components|vendored|jspm_packages|site-packages|Godeps|Pods|Carthage)/", re.I)
GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|generated|__generated__|build/stubs)/|(?:\.gen|\.generated|\.g|_generated|_pb2|_pb2_grpc|\.pb|\.pb\.gw|_grpc_pb|\.designer)\.[A-Za-z]+$")
LOCK_FILE = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|Gemfile\.lock|Cargo\.lock|poetry\.lock|Pipfile\.lock|uv\.lock|go\.sum|gradle\.lockfile|mix\.lock|flake\.lock|bun\.lockb?)$"
)
MINIFIED_PATH = re.compile(r"[.\-]min\.(?:js|mjs|cjs|css|ts|html)$|\.(?:js|css|ts)\.map$|(?:^|/)bundle\.js(?:\.json)?$", re.I)
TABLE_NAME = re.compile(r"(?m)^[ \t]*(?:(?:export|static|final|public|private|var|const|let|int|final|int\[\])[ \t]+)*(?:int\[\][ \t]+)?_?(?:LR_|lr_|lr(?=[A-Z])|yy|YY_?|_?lr_)(?:ACTION|GOTO|action|goto|Action|Goto|table|productions|defact|check|pact|act|exca)\w*[ \t]*(?::[^=\n]*)?:?=")
JSON_PIECE = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]]', re.S)
MAP_VALUE = {'"version"': re.compile(r"\s*:\s*\d"), '"mappings"': re.compile(r'\s*:\s*"'), '"sections"': re.compile(r"\s*:\s*\[")}
LOCK_TEXT = re.compile(r'^\s*\{\s*(?:"name"[^{}]*?)?"lockfileVersion"\s*:|^# THIS IS AN AUTOGENERATED|^lockfileVersion:', re.S)
SCRIPTS = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".css", ".html")
CODE = (".py", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".go", ".java", ".c", ".h", ".cpp", ".cs", ".rb", ".php", ".rs", ".swift", ".kt", ".scala")
COMMENT_LINE = re.compile(r"\s*(?://|#|/\*|\*|;|--|<!--|\"\"\"|''')")
DATA_LINE = re.compile(r"""\s*[\[({]*\s*(?:(?:[+-]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)|[bru]?"[^"\s]*"|[bru]?'[^'\s]*'|[bru]?"(?:\\x[0-9a-fA-F]{2})+")\s*[,:;+\])}]*\s*)+$""")
NEUTRAL_LINE = re.compile(r"\s*(?:$|import\b|from\b|package\b|\"[\w./\-]+\"$|using\b|#include\b|require\b|use\b|[\])};,()]+$|import \($|//|#|/\*|\*|\"use strict\"|'use strict')")
NUMBERED = re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?(?:public[ \t]+|static[ \t]+|async[ \t]+)*(?:def|function|func(?:[ \t]*\([^)]*\))?|[\w<>\[\]]+)?[ \t]*\b([A-Za-z_]+?)_?(\d+)[ \t]*\([^\n]*[{:]?[ \t]*\r?$")


def source_map(text: str) -> bool:
    """Whether the text is a JSON object with a version and mappings, or sections that have them, wherever these keys stand."""
    if not text.lstrip().startswith("{") or '"mappings"' not in text or '"version"' not in text:
        return False
    depth, keys = 0, set()
    for m in JSON_PIECE.finditer(text):
        piece = m[0]
        if piece in "{[":
            depth += 1
        elif piece in "}]":
            depth -= 1
        elif depth == 1 and piece in MAP_VALUE and MAP_VALUE[piece].match(text, m.end()):
            keys.add(piece)
            if len(keys) > 1 and '"version"' in keys:
                return True
    return False


class Notices:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for w in GENERATED:
            self.automaton.add_word(w, (w, "generated"))
        for w in THIRD_PARTY:
            self.automaton.add_word(w, (w, "third_party"))
        self.automaton.make_automaton()

    def find(self, head: str) -> str:
        lower = head.lower()
        kinds = set()
        for end, (word, kind) in self.automaton.iter(lower):
            line_at = lower.rfind("\n", 0, end) + 1
            stop = lower.find("\n", end)
            line = lower[line_at : stop if stop >= 0 else len(lower)]
            if BY_HAND.search(line):
                continue
            before = lower[line_at : end - len(word) + 1]
            if kind == "third_party":
                kinds.add(kind)
            elif not AT_HEAD.sub("", before, count=1).strip() or word.startswith(("this file", "do not", "code gen", "automat", "regenerate", "@gen", "<auto")):
                kinds.add(kind)
        return "generated" if "generated" in kinds else "third_party" if kinds else ""


_NOTICES: list[Notices] = []


def head_comments(text: str) -> str:
    """The comments and docstring before the first line of code."""
    out, closing = [], ""
    for line in text.split("\n"):
        body = line.strip()
        if closing:
            out.append(line)
            if closing in body:
                closing = ""
            continue
        if not body or body.startswith(("#!", "<?", "'use strict'", '"use strict"')):
            continue
        if body.startswith("/*"):
            out.append(line)
            closing = "" if "*/" in body[2:] else "*/"
        elif body.startswith("<!--"):
            out.append(line)
            closing = "" if "-->" in body else "-->"
        elif body.startswith(('"""', "'''")):
            out.append(line)
            closing = "" if body.count(body[:3]) > 1 else body[:3]
        elif body.startswith(("//", "#", "--", ";", "*")):
            out.append(line)
        else:
            break
    return "\n".join(out)


def minified(text: str) -> bool:
    """Dense code on long lines; strings and comments say nothing about either."""
    if len(text) < 200:
        return False
    plain = re.sub(r"/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?m:^[ \t]*//.*$)", "", text, flags=re.S)
    lines = [x for x in plain.split("\n") if x.strip()]
    if len(plain) < 100 or not lines:
        return False
    return len(plain) / len(lines) > 80 and sum(map(plain.count, " \t\n")) < 0.1 * len(plain) and sum(map(plain.count, ";,(){}")) > 0.1 * len(plain)


def data_share(text: str) -> float:
    """Share of the characters of code that stand on lines of nothing but literals."""
    data = code = 0
    for line in text.split("\n"):
        n = len(line.strip())
        if not n or NEUTRAL_LINE.match(line):
            continue
        if DATA_LINE.match(line):
            data += n
        code += n
    return data / code if code else 0.0


def numbered_accessors(text: str) -> bool:
    """A run of short functions whose names end in consecutive numbers and whose bodies have one shape."""
    names = [(m[1], int(m[2]), m.start(), m.end()) for m in NUMBERED.finditer(text)]
    names = [x for x in names if not re.match(r"\s*(?:if|for|while|switch|return|elif|with|else)\b", text[x[2] : x[3]])]
    if len(names) < 4:
        return False
    in_turn = sum(b[1] == a[1] + 1 for a, b in zip(names, names[1:], strict=False))
    if in_turn < 0.8 * (len(names) - 1):
        return False
    shapes = Counter()
    lines = 0
    for (_, _, _, end), nxt in zip(names, [*(x[2] for x in names[1:]), len(text)], strict=True):
        body = text[end:nxt].strip().split("\n\n")[0]
        lines += body.count("\n") + 2
        shapes[re.sub(r"\W+", " ", re.sub(r"\d\w*", "9", re.sub(r"\"[^\"]*\"|'[^']*'", "s", re.sub(r"[A-Za-z_]\w*", lambda m: m[0] if m[0] in ("return", "if", "this", "null", "nil") else "w", body))))] += 1
    return shapes.most_common(1)[0][1] >= 0.7 * len(names) and lines >= 0.5 * sum(1 for x in text.split("\n") if x.strip() and not NEUTRAL_LINE.match(x))


def why(path: str, text: str | None) -> str:
    """The reason why a file isn't hand-written by its own path and text; empty if there is none."""
    if LOCK_FILE.search(path):
        return "lock_file"
    if text:
        if source_map(text):
            return "source_map"
        if LOCK_TEXT.match(text):
            return "lock_file"
    if MINIFIED_PATH.search(path) and not (text and len(text) > 400 and "\n" in text and not minified(text) and not text.lstrip().startswith("{")):
        return "minified"
    ext = re.search(r"\.[^./]+$", path)
    ext = ext[0].lower() if ext else ""
    if not _NOTICES:
        _NOTICES.append(Notices())
    notice = _NOTICES[0].find(head_comments(text)) if text else ""
    if VENDOR_PATH.search(path) or notice == "third_party":
        return "third_party"
    if notice or GENERATED_PATH.search(path):
        return "generated"
    if not text:
        return ""
    if ext in SCRIPTS and minified(text):
        return "minified"
    if TABLE_NAME.search(text) and ext in CODE:
        return "generated"
    if ext in CODE:
        if len(text) > 300 and data_share(text) >= 0.8:
            return "data"
        if numbered_accessors(text):
            return "generated"
    elif ext == ".sh" and numbered_accessors(text):
        return "generated"
    return ""


WORD = re.compile(r"\w+")
_WORD_HASH: dict[str, int] = {}
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of five-word shingles, ascending; a shorter text is one shingle."""
    known = _WORD_HASH
    words = WORD.findall(text)
    try:
        w = np.array([known[x] for x in words], dtype=np.uint64)
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for x in words:
            if x not in known:
                known[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        w = np.array([known[x] for x in words], dtype=np.uint64)
    if not len(w):
        return np.zeros(0, dtype=np.int64)
    n = max(1, len(w) - SHINGLE + 1)
    if len(w) < SHINGLE:
        w = np.concatenate([w, np.zeros(SHINGLE - len(w), dtype=np.uint64)])
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ (w[k : k + n] * MIX[k])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


JUDGED = "project_id string, rel_path string, digest binary, reason string, shingles array<bigint>"


def judged(texts: DataFrame) -> DataFrame:
    """Every file with the reason found in itself, the digest of its text and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                paths, bodies = part.column(1).to_pylist(), part.column(2).to_pylist()
                reasons = [why(p or "", t) for p, t in zip(paths, bodies, strict=True)]
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if t else None for t in bodies]
                sets = [shingles(t) if t and r in ("", "third_party") else None for t, r in zip(bodies, reasons, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(reasons, pa.string()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["project_id", "rel_path", "digest", "reason", "shingles"],
                )

    return texts.select("project_id", "rel_path", "text").mapInArrow(run, JUDGED)


WITNESSES = 4  # known texts of a shingle that are compared first; the others where these show no copy
ORDER_SAMPLE = 2000  # known texts from which the frequent shingles are known; they only order the prefixes


def copies_of(known: DataFrame, others: DataFrame) -> DataFrame:
    """Digests of the others whose shingle set has a Jaccard similarity of SIMILAR or more with a known one. Exact.

    Both: (digest, shingles), equal texts may be repeated. In an order common to both sides, two such sets share one of
    their first n - ceil(SIMILAR * n) + 1 shingles; those frequent in the known ones come last in that order, so that no shingle has
    many known texts (one with few of them meets any number of others in proportion). Whole
    sets are shuffled only for texts that are in a pair. One known text is enough for a copy: WITNESSES of each shingle are
    compared first, and only texts that these don't show to be copies are compared with all, so that many forms of a library
    and many copies of it don't give all their pairs.
    """
    part = max(1, known.count() // ORDER_SAMPLE)
    sample = known.where(F.pmod(F.xxhash64("digest"), F.lit(part)) == 0).select(F.explode("shingles").alias("s"))
    counted = stored(sample.groupBy("s").count().where("count >= 10"), "frequent")
    frequent = [r["s"] for r in most_frequent(counted, "count", 20_000).collect()]
    late = known.sparkSession.sparkContext.broadcast(np.array(sorted(frequent), dtype=np.int64))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value
        for batch in batches:
            digests, keys, sizes, ats = [], [], [], []
            for d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.array(s, dtype=np.int64)
                n = len(a)
                if not n:
                    continue
                a = a[np.argsort(np.isin(a, last, assume_unique=True), kind="stable")]
                take = n - int(np.ceil(SIMILAR * n - 1e-9)) + 1
                digests += [d] * take
                keys.append(a[:take])
                sizes.append(np.full(take, n))
                ats.append(np.arange(take))
            flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, sizes, ats)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))], names=["digest", "s", "n", "at"]
            )

    schema = "digest binary, s bigint, n int, at int"
    a = stored(known.select("digest", "shingles").mapInArrow(prefix, schema).distinct().toDF("da", "s", "na", "pa"), "known")
    b = possibly_in(others.select("digest", "shingles").mapInArrow(prefix, schema), "s", a, "s").distinct().toDF("db", "s", "nb", "pb")
    b = stored(b, "others")
    need = F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("na") + F.col("nb")) - 1e-9)

    def similar(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = (
            a.join(b, "s")
            .where((F.col("nb") >= SIMILAR * F.col("na") - 1e-9) & (F.col("na") >= SIMILAR * F.col("nb") - 1e-9))
            .where(1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) + F.least("pa", "pb") >= need)
            .select("da", "db")
            .distinct()
        )
        pairs = stored(pairs, "similar")
        if pairs.isEmpty():
            return pairs.select("db")  # and no set is read
        needed = lambda df, c: possibly_in(df.select("digest", "shingles"), "digest", pairs, c).groupBy("digest").agg(F.first("shingles").alias("shingles"))
        sa, sb = needed(known, "da").toDF("da", "sa"), needed(others, "db").toDF("db", "sb")
        common = F.size(F.array_intersect("sa", "sb"))
        jaccard = common / (F.size("sa") + F.size("sb") - common)
        return pairs.join(sa, "da").join(sb, "db").where(jaccard >= SIMILAR - 1e-9).select("db").distinct()

    few = a.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("pa", "da"))).where(F.col("r") <= WITNESSES).drop("r")
    shown = stored(similar(few, b), "copies")
    many = a.groupBy("s").count().where(F.col("count") > WITNESSES).select("s")  # where the first ones were all, nothing is left
    rest = b.join(shown, "db", "left_anti").join(many, "s", "left_semi")
    return shown.unionByName(similar(a, rest)).select(F.col("db").alias("digest")).distinct()


def not_handwritten(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, rel_path, reason): generated, minified, third_party, data, lock_file or source_map; or copy."""
    keys = files.select("project_id", "rel_path").where("rel_path is not null").distinct()
    texts = file_texts(chunks)
    told = stored(judged(texts), "judged")
    bare = keys.join(told.select("project_id", "rel_path"), ["project_id", "rel_path"], "left_anti")
    named = judged(bare.withColumn("text", F.lit(None).cast("string")))
    own = told.unionByName(named).where("reason <> ''").select("project_id", "rel_path", "reason")
    sets = told.where("shingles is not null and size(shingles) > 0")
    known, others = sets.where("reason = 'third_party'"), sets.where("reason = ''")
    same = sets.where("reason = 'third_party'").select("digest").distinct()
    similar = copies_of(known, others).unionByName(same).distinct()
    copied = told.where("reason = ''").join(similar, "digest", "left_semi").select("project_id", "rel_path", F.lit("copy").alias("reason"))
    return own.unionByName(copied).join(keys, ["project_id", "rel_path"], "left_semi")
