"""Problem 6: credential values in source code, found by their unexplained characters and masked in place.

Every quoted literal, and every bare value behind an operator, is segmented by Viterbi into words of the corpus's own
dictionary; what no word explains is its residual. What is asked of the residual depends on the context: the words on both
sides of the literal, read from the nearest outwards (assigned name, call, first of a pair, default of a reference, compared
name, element, entry whose name stands on the line before, remark behind or above it). Where a password is named, a value of
words with digits counts too, unless its words say that it is a placeholder; where nothing is named, a value must be very
long, unexplained and of mixed cases and digits. Vendor formats, addresses, headers and private keys mark themselves; their
residual is asked for as well. Values in a hash's format count only where a secret is named. Placeholders, references,
sentences, checksums, ids and public keys don't count. Lines are searched whole, whatever their length.

Defined results: null and empty contents have no rows in found and stay as they are when masked; repeated rows of a
chunk count once; values are replaced by as many letters x, so that quotes, escapes, separators and line ends stay.

Both operators count the dictionary when they are called (one pass over the contents), before they return a DataFrame.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, stored

WORDS_KEPT = 60_000  # dictionary entries that are broadcast (under 1 MB); the most frequent ones
RESIDUAL = 8  # unexplained characters that make a literal a secret
UNNAMED_RESIDUAL = 16  # the same where nothing names a credential
SLICE, ENOUGH = 256, 64  # longer literals are segmented in slices, up to so many unexplained characters
RANDOM_LETTERS = 88  # a word must be more frequent than in rows of so many random letters
REACH = 200  # characters on either side of a literal whose names count

#: Needles of the automaton, lower case (fixed values). Every word that a rule below accepts holds one of them.
NEEDLES = (
    "pass", "kennwort", "pwd", "sig=", "signature=", "-u ", "-u\t", "-u=", "-user", "-p", "connect", "logon", "signin", "sign_in", "log_in", "secret", "token", "key", "auth", "bearer", "credential", "login", "://", "-----begin",
    "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xox", "npm_", "pypi-", "akia", "asia",
    "aiza", "sg.", "eyj", "hf_", "shpat_", "dop_v1_",
)
#: Vendor formats: the mark and the body (fixed values).
VENDOR = re.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:"
    r"(?:gh[posu]_|github_pat_|glpat-|sk_(?:live|test)_|rk_live_|npm_|pypi-|hf_|shpat_|dop_v1_)[A-Za-z0-9_\-]{3,}"
    r"|xox[abprs]-[A-Za-z0-9\-]{6,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{4,16}(?![A-Za-z0-9])"
    r"|AIza[A-Za-z0-9_\-]{12,}|SG\.[A-Za-z0-9_\-]{12,}\.[A-Za-z0-9_\-]{12,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
)
VENDOR_NEEDLES = {"ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xox", "npm_", "pypi-", "akia", "asia", "aiza", "sg.", "eyj", "hf_", "shpat_", "dop_v1_"}
VENDOR_MARK = re.compile(r"^(?:gh[posu]_|github_pat_|glpat-|[sr]k_(?:live|test)_|npm_|pypi-|hf_|shpat_|dop_v1_|xox[abprs]-|AKIA|ASIA|AIza|SG\.)")
WRAPPED = re.compile(r"\\\r?\n([A-Za-z0-9+/=_.\-]+)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: the lines of a key whose end is missing: nothing but base64, broken by line ends, quotes and signs that join literals
KEY_LINES = re.compile(r"(?:(?:\\[nr]|[\s\"'`+,.\\|>])*+(?:(?:Proc-Type|DEK-Info): ?[^\s\\\"'`]++|[A-Za-z0-9+/]{12,}+=*+(?=\\[nr]|[\s\"'`]|$)))*+(?:(?:\\[nr]|[\s\"'`+,.\\|>])*+[A-Za-z0-9+/]{1,11}={1,2})?")
ADDRESS = re.compile(r"(?<![A-Za-z0-9+.\-])[0-9+.\-]*+[A-Za-z][A-Za-z0-9+.\-]*+://[^\s/:@\"'`<>{}$]*:([^\s/@\"'`]+)@[A-Za-z0-9\[{$<]")
QUERY = re.compile(r"(?i)[?&](?:auth|auth_token|token|access_token|api_?key|key|secret|password|passwd|pwd|sig|signature|client_secret)=([^\s&\"'`#<>)]+)")
FLAG = re.compile(r"(?i)(?<![\w-])--?(?P<name>[a-z][a-z0-9-]*)[ \t]+[\"'`]?(?P<v>[^\s\"'`,;()<>|&]{6,})")
HEADER = re.compile(r"(?i)authorization\\?[\"']?\]?\s*[:,=]?\s*\\?[\"']?\s*(basic|bearer|token)\s+([A-Za-z0-9+/=._~\-]{8,})")
#: user and password behind curl's -u, and as a pair in prose
USER_FLAG = re.compile(r"(?<![\w-])(?:-u|--user|--proxy-user)[ \t=]+[\"'`]?[^\s:\"'`/]+:(?P<v>[^\s\"'`]+)")
PAIR = re.compile(r"(?i)\b(?:login|credentials?)[ \t]*(?:is|was|are|:|=)?[ \t]+[\"'`]?[\w.@\-]+[ \t]*/[ \t]*(?P<v>[^\s\"'`,;()]{6,})")
#: password behind a client's -p or --password, and in a machine entry
SHORT_FLAG = re.compile(r"(?i)\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass|redis-cli|mongo|mongosh|docker login|sqlcmd)\b[^\n|;&]{0,160}?[ \t]-[pPa](?:[ \t]+)?[\"']?(?P<v>[^\s\"'`|;&\-][^\s\"'`|;&]{5,})")
NETRC = re.compile(r"(?i)\blogin[ \t]+\S+\s+password[ \t]+(?P<v>\S{4,})")
#: a quoted literal that doesn't open within a word; its end may be missing
LITERAL = re.compile(r"(?<![A-Za-z0-9_])(?P<prefix>[rRbBuUfF]{1,2}(?=[\"']))?(?P<q>\\?\"\"\"|'''|\\?\"|\\?'|`)(?P<v>(?:(?!(?P=q))[^\n\\]|\\(?![\"'])[^\n]|\\\r?\n)*+)(?P=q)?")
#: what follows a literal that is itself a name
IS_KEY = re.compile(r"[ \t]*(?::(?![:=])[ \t]*[^\s#]|=>|=(?!=))")
QUOTE, DIGIT, SPACE, LETTERS = re.compile(r"[\"'`]"), re.compile(r"\d"), re.compile(r"\s"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
JOINABLE = (" ", "\t", "+", ".", "\\", "\r", "\n", '"', "'", "`")  # what follows a literal that another one continues
WRAP = re.compile(r"\\\r?\n")
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
#: names behind an operator on the right of a literal
COMPARED = re.compile(r"[ \t]*(?:===?|!==?|\.equals\(|\.compareTo\()[ \t]*(?P<name>[A-Za-z_][\w.]*)")
#: a comment behind a literal, or alone on its line
REMARK = re.compile(r"[\"'`),; \t](?:#|//|/\*|--)[ \t]*([^\n]*)")
REMARK_LINE = re.compile(r"[ \t]*(?:#|//|/\*+|--|\*)[ \t]*([^\n]*)")
#: ends of lines that go on, and entries whose value stands on the next line
OPEN_END = re.compile(r"(?:[=(,\[{:+|?\\]|[>|][+\-]?)$")
ENTRY = re.compile(r"(?i)(?:^|[\s{\-\"'])(?:name|key|id|option|setting|variable|property)[\"']?[ \t]*[:=][ \t]*[\"']?(?P<name>[\w.\-]+)[\"']?,?$")
#: calls that open a session with a user and a password
OPENING = re.compile(r"(?i)(?:^|[._])(?:re)?(?:connect|login|log_in|logon|signin|sign_in|authenticate|auth|basicauth|basic_auth|httpbasicauth|setbasicauth|createuser|create_user)(?:[A-Z_]\w*)?$")
JOINED = re.compile(r"join\(\s*\[\s*$|Arrays\.asList\(\s*$")
LISTED = re.compile(r"\s*,\s*[rbu]{0,2}(?P<q>\"|'|`)(?P<v>[^\"'`\n]*)(?P=q)")
NAME = r"(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)"
#: name, closing quote or bracket, type annotation, operator of a bare value: assignment, entry, element, block scalar, blank
NAMED = re.compile(
    NAME + r"(?P<op>\\?[\"'`]?\]?[ \t]*(?::[ \t]*[A-Za-z][\w<>\[\], .|]{0,60}?[ \t]*=(?!=)|:=|=>|===?|=(?![=>])|:(?!:))[ \t]*(?:[|>][+\-]?[ \t]*\r?\n[ \t]+)?|[ \t]*>|[ \t]+)"
)
VALUE = re.compile(r"[^\s\"'`,;()\[\]]++")
#: a name, and its value as the next entry
NAMED_ENTRY = re.compile(r"(?i)\bname[\"']?[ \t]*[:=][ \t]*[\"']?(?P<name>[A-Za-z_][\w.\-]*)[\"']?[ \t]*,?[ \t]*\r?\n?[ \t]*[\"']?value[\"']?[ \t]*[:=][ \t]*(?P<v>[^\s\"'`{}\[\]]+)")
#: a long bare value under any other name
NAME_BEFORE = re.compile(NAME + r"[ \t]*:?$")
UNNAMED = re.compile(r"(?:=>?|:)[ \t]*(?<!//)(?P<v>[A-Za-z0-9+/_.~\-]{20,}+=*)(?=\s|$)")
JOIN = re.compile(r"(?:[ \t]*(?:\+|\.|\\)?[ \t]*\\?\r?\n?[ \t]*(?:\+|\.)?[ \t]*)[rbuf]{0,2}(?P<q>\"|'|`)(?P<v>[^\"'`\n]*)(?P=q)")
PROSE = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|passcode|token|secret|api[ _-]?key|credentials?|login)\b(?:[^\n\"'`=:]{0,40}?(?P<link>\b(?:is|with|to|was|are)\b|:|=))?[ \t]+[\"'`]?(?P<v>[^\s\"'`,;()]{6,})")
PLACEHOLDER = re.compile(
    r"(?i)(?:your|my|the)?[_\-]?(?:change[_\-]?me.*|replace[_\-]?me.*|none|null|nil|undefined|true|false|todo|tbd|fixme|redacted|masked|hidden|removed|"
    r"example.*|.*[_\-]?example|sample|dummy.*|fake.*|test|testing|placeholder.*|empty|default|string|str|required|optional|password|passwd|secret|token|key|"
    r"your[_\-].*|.*_here|insert[_\-].*|xxx+|(.)\1+|x{3,}.*|\*+|\.{2,}|-+|0+|1234\d*|abc123|vault[_\-:/].*|env[_\-:.].*)"
)
REFERENCE = re.compile(r"[<>{}$%]|\$\(|\.\.\.|^process\.env|^os\.|^env\b|getenv|^\./|^\.\./|\*{3,}|^vault:|^arn:|^secretKeyRef|^ref\+|^!", re.I)
#: values with a part that is put in later; a password may hold any sign
TEMPLATE = re.compile(r"\$\{|\$\(|\{\{|#\{|%\(|%[sdv](?![A-Za-z0-9])|^<[^<>]*>$|^\{[\w.]*\}$|^\$[A-Za-z_]\w*$|^%\w+%$|^@\w+@$|^process\.env|^os\.|^env\b|getenv|^\./|^\.\./|\*{3,}|\.\.\.|^vault:|^arn:|^secretKeyRef|^ref\+|^!|://|=>|^[\w.]+\(|^-")
UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
HASHED = re.compile(r"(?i)(?:sha\d+|md5|blake2b?)[-:$=].+|\$2[aby]\$.*|ssh-[a-z0-9]+.*|ecdsa-.*|[0-9a-f]{7,}")
HASH_PREFIX = re.compile(r"(?i)(?:sha\d+|md5|blake2b?)[-:$]|ssh-|ecdsa-")
PASSWORD_WORDS = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "passwort", "kennwort"}
LONG_PASSWORD_WORDS = ("password", "passwd", "passphrase", "passcode", "passwort", "kennwort")
SECRET_WORDS = {"secret", "token", "apikey", "authtoken", "accesstoken", "credential", "credentials", "auth", "bearer"}
KEY_BEFORE = {"api", "access", "signing", "secret", "private", "auth", "encryption", "hmac", "master", "account", "storage", "deploy", "service", "client", "legacy", "shared", "session", "cookie", "crypto", "webhook"}
OTHER_WORDS = {
    "public", "hint", "help", "label", "file", "ref", "path", "url", "uri", "name", "length", "len", "policy", "field", "header", "type", "count", "expiry",
    "expires", "ttl", "id", "ids", "regex", "pattern", "prompt", "message", "msg", "error", "title", "text", "description", "env", "var", "digest", "hash",
    "checksum", "integrity", "commit", "uuid", "host", "fingerprint", "kind", "format", "min", "max", "provider", "endpoint", "placeholder", "rule", "rules",
}
#: words of values that say what should stand there (fixed values)
PLACEHOLDER_WORDS = {"your", "my", "the", "a", "here", "change", "changeme", "replace", "me", "this", "insert", "example", "sample", "dummy", "fake", "test", "testing", "placeholder", "default", "some", "value", "new", "old", "user", "key", "api", "db", "enter", "put", "todo", "none", "null", "empty", "masked", "redacted", "hidden", "field", "input", "string", "base"}
#: words of names that only say "a value", and of the calls, types and operators around one
NEUTRAL = {
    "value", "val", "v", "default", "data", "text", "string", "str", "or", "is", "new", "to", "decode", "encode", "encoded", "from", "bytes", "byte", "buffer", "of", "b", "base", "set", "get", "put", "add", "param", "parameter", "const",
    "let", "var", "final", "env", "getenv", "environ", "process", "os", "equals", "compare", "digest", "safe", "trim", "join", "concat", "else", "return", "if", "elif", "when", "then", "not", "and", "in", "assert", "expect", "some", "ok", "optional", "any", "char",
    "chars", "array", "object", "public", "private", "static", "export", "readonly", "property", "append", "write", "update", "hmac", "lookup", "as", "self", "this", "config", "settings", "options", "opts", "cfg", "conf", "props", "entry", "system", "literal", "type", "s", "strip", "by", "lazy",
}
#: first literals of a pair of user and password
USERS = {"admin", "root", "user", "username", "svc", "service", "postgres", "sa", "guest", "administrator", "deploy", "deployer", "ci", "bot", "operator", "login"}
#: words of names whose long values are no credentials, whatever they look like
PUBLIC_WORDS = {"public", "digest", "hash", "checksum", "integrity", "commit", "sha", "etag", "uuid", "id", "ids", "fingerprint", "path", "url", "uri", "file", "data", "image", "blob", "mappings", "regex", "pattern"}
PIECE = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in PIECE.findall(name) if not w.isdigit()]


ENVIRONMENT = re.compile(r"^(?:process\.env|import\.meta\.env|os\.environ|ENV)\.")


@lru_cache(100_000)
def context(name: str) -> str:
    """What a name promises of its value: password, secret, key or nothing."""
    words = name_words(ENVIRONMENT.sub("", name))
    if not words or OTHER_WORDS.intersection(words):
        return ""
    if PASSWORD_WORDS.intersection(words) or any(w.endswith(LONG_PASSWORD_WORDS) for w in words):
        return "password"
    if SECRET_WORDS.intersection(words) or any(w.endswith(("secret", "token", "apikey")) for w in words):
        return "secret"
    if "key" in words or "keys" in words:
        return "secret" if KEY_BEFORE.intersection(words) or len(words) == 1 else "key"
    return ""


class Segmenter:
    """Viterbi segmentation of a literal into dictionary words, digits and single unexplained characters."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = min(20, max(map(len, self.cost), default=1))
        self.known: dict[str, tuple[int, tuple[str, ...]]] = {}

    def residual(self, literal: str) -> int:
        """Characters of letters and digits that no word explains; runs of one to four digits count as explained.

        Literals of more than SLICE characters are segmented slice by slice, until ENOUGH unexplained ones are counted:
        no rule asks for more.
        """
        if len(literal) <= SLICE:
            return self.segments(literal)[0]
        count = 0
        for at in range(0, len(literal), SLICE):
            count += self._best(literal[at : at + SLICE])[0]
            if count >= ENOUGH:
                break
        return count

    def segments(self, literal: str) -> tuple[int, tuple[str, ...]]:
        """The residual and the words of the cheapest segmentation."""
        got = self.known.get(literal)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[literal] = self._best(literal)
        return got

    def _best(self, literal: str) -> tuple[int, tuple[str, ...]]:
        text, n = literal.lower(), len(literal)
        if len(text) != n:
            text = "".join(c.lower() if len(c.lower()) == 1 else c for c in literal)
        best = [0.0] + [math.inf] * n
        odd = [0] * (n + 1)
        word_at = [0] * (n + 1)  # where the word that ends here begins; itself if none does
        for i in range(n):
            here = best[i]
            ch = text[i]
            step, counted = (6.0, 1) if ch.isalnum() else (1.0, 0)
            if here + step < best[i + 1]:
                best[i + 1], odd[i + 1], word_at[i + 1] = here + step, odd[i] + counted, -1
            if ch.isdigit() and (i == 0 or not text[i - 1].isdigit()):
                j = i
                while j < n and text[j].isdigit():
                    j += 1
                if j - i <= 4 and (j == n or not text[j].isalpha() or i == 0 or not text[i - 1].isalpha()) and here + 4.0 < best[j]:
                    best[j], odd[j], word_at[j] = here + 4.0, odd[i], -1 - (j - i)
            if ch.isalpha():
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    c = self.cost.get(text[i:j])
                    if c is not None and here + c < best[j]:
                        best[j], odd[j], word_at[j] = here + c, odd[i], i
        words, j = [], n
        while j > 0:
            i = word_at[j]
            if i >= 0:
                words.append(text[i:j])
                j = i
            else:
                j -= max(1, -1 - i)
        return odd[n], tuple(reversed(words))


class Finder:
    def __init__(self, counts: dict[str, int]):
        self.seg = Segmenter(counts)
        self.automaton = ahocorasick.Automaton()
        for w in NEEDLES:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def placeholder(self, value: str) -> bool:
        """Values that say what should stand there: known forms, or words of which all belong to such forms."""
        if PLACEHOLDER.fullmatch(value):
            return True
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]
        return bool(words) and all(w in PLACEHOLDER_WORDS or w in PASSWORD_WORDS or w in SECRET_WORDS for w in words) and not re.search(r"[^\w\-. ]", value)

    def accept(self, kind: str, value: str) -> bool:
        """Whether a value of that kind of context is a credential, by what its segmentation leaves unexplained."""
        if len(value) < (4 if kind == "password" else 6) or self.placeholder(value):
            return False
        if UUID.fullmatch(value) or HASH_PREFIX.match(value):
            return False
        if value.startswith("/") and self.seg.residual(value) < 12:  # a path
            return False
        if kind == "password":
            if TEMPLATE.search(value):
                return False
            residual, words = self.seg.segments(value) if len(value) <= SLICE else (self.seg.residual(value), ())
            if SPACE.search(value):  # words with blanks are a message unless much of them is unexplained
                return residual >= 6 and residual * 3 >= len(value) and bool(DIGIT.search(value))
            if len(value) < 6:
                return bool(DIGIT.search(value) and re.search(r"[A-Za-z]", value)) and residual + len(words) > 0
            return bool(DIGIT.search(value) and re.search(r"[A-Za-z]", value)) or residual >= 5
        if REFERENCE.search(value) or SPACE.search(value):
            return False
        if HASHED.fullmatch(value):
            return kind == "secret" and len(value) >= 16
        if not re.fullmatch(r"[A-Za-z0-9+/=_.~!@#^&*\-]+", value):
            return False
        residual = self.seg.residual(value)
        if residual < 12 and re.fullmatch(r"[a-z_]+(?:[.\-/_][a-z_]+)*|[A-Z_]+|[a-zA-Z]+", value):
            return False
        if kind == "remark":
            return residual >= 12 and bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and DIGIT.search(value))
        return residual >= RESIDUAL

    def _parts(self, text: str, at: int, join: re.Pattern | None = None) -> list[tuple[int, int]]:
        """Further literals that a value beginning before at is put together from."""
        found = []
        while True:
            m = (join or JOIN).match(text, at)
            if m is None or not re.fullmatch(r"[A-Za-z0-9+/=_.~!@#$%^&*\-]+", m["v"] or ""):
                return found
            between = text[at : m.start("q")]
            if join is None and "+" not in between and "." not in between and "\n" not in between and between.strip("rbuf \t"):
                return found
            found.append((m.start("v"), m.end("v")))
            at = m.end()

    def find(self, text: str | None) -> list[list[tuple[int, int]]]:
        """Credential values, each as the spans of its parts, in order."""
        if not text:
            return []
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        needles = {w for _, w in self.automaton.iter(lower)}
        found: dict[int, list[tuple[int, int]]] = {}
        starts: list[int] = []  # of the spans taken so far, in order, with their ends
        ends: list[int] = []

        def take(a: int, b: int) -> None:
            at = bisect_right(starts, a)
            starts.insert(at, a)
            ends.insert(at, b)

        def free(a: int, b: int) -> bool:
            at = bisect_right(starts, b - 1)  # spans don't overlap, so the last that begins before b reaches furthest
            return at == 0 or ends[at - 1] <= a

        def add(spans: list[tuple[int, int]]) -> None:
            if spans and free(*spans[0]):
                found[spans[0][0]] = spans
                for span in spans:
                    if free(*span):
                        take(*span)

        if "-----begin" in needles:
            for m in PEM.finditer(text):
                end = PEM_END.search(text, m.end())
                stop = end.end() if end else KEY_LINES.match(text, m.end()).end()
                body = [(b.start(), b.end()) for b in re.finditer(r"(?<!\\)[A-Za-z0-9+/=]{12,}|(?<=\\n)[A-Za-z0-9+/=]{12,}", text[: end.start() if end else stop][m.end() :])]
                if (body or not end) and free(m.start(), stop):
                    begin = m.end()
                    spans = [(begin + a, begin + b) for a, b in body] or [(m.start(), m.end())]
                    found[m.start()] = spans
                    take(m.start(), stop)
        if needles:
            self._formats(text, needles, add)
        self._literals(text, add)
        if needles:
            self._bare(text, add)
        self._unnamed(text, add)
        return [found[k] for k in sorted(found)]

    def _formats(self, text: str, needles: set[str], add) -> None:
        """Values whose own form or surrounding format marks them: vendors' tokens, addresses, headers, flags, prose."""
        if needles & VENDOR_NEEDLES:
            for m in VENDOR.finditer(text):
                body = VENDOR_MARK.sub("", m[0])
                parts = []
                if m.end() < len(text) and text[m.end()] in "\"'`":
                    parts = self._parts(text, m.end() + 1)
                elif tail := WRAPPED.match(text, m.end()):
                    parts = [tail.span(1)]
                whole = body + "".join(text[x:y] for x, y in parts)
                if len(whole) < 12 or PLACEHOLDER.fullmatch(body) or re.search(r"(?i)example|x{5,}|(.)\1{6,}|your[_-]", whole):
                    continue
                if self.seg.residual(whole) >= 6:
                    add([m.span(), *parts])
        if "://" in needles:
            for m in ADDRESS.finditer(text):
                value = m[1]
                if len(value) >= 4 and not self.placeholder(value) and not TEMPLATE.search(value) and (DIGIT.search(value) or self.seg.residual(value) >= 4):
                    add([m.span(1)])
        for m in QUERY.finditer(text) if "?" in text or "&" in text else ():
            if self.accept("secret", m[1]):
                add([m.span(1)])
        for m in HEADER.finditer(text) if "auth" in needles else ():
            value = m[2]
            if not self.placeholder(value) and not REFERENCE.search(value) and (self.seg.residual(value) >= RESIDUAL or HASHED.fullmatch(value)) and not re.fullmatch(r"[a-z_]+", value):
                add([m.span(2)])
        for pattern, marks in ((USER_FLAG, ("-u ", "-u\t", "-u=", "-user")), (PAIR, ("login", "credential")), (SHORT_FLAG, ("-p",)), (NETRC, ("login",))):
            for m in pattern.finditer(text) if needles.intersection(marks) else ():
                if self.accept("password", m["v"]):
                    add([m.span("v")])
        for m in FLAG.finditer(text):
            kind = context(m["name"])
            if kind and not m["v"].startswith("-") and self.accept(kind, m["v"]):
                add([m.span("v")])
        for m in PROSE.finditer(text):
            value = m["v"].rstrip(".!?:")
            if DIGIT.search(value) and re.search(r"[A-Za-z]", value) and not re.search(r"[=(){}\[\]]", value):
                if m["link"] is None and not (re.search(r"[a-z]", value) and re.search(r"[A-Z]|[^\w.\-/]", value)):
                    continue
                if self.accept("password" if re.match(r"(?i)pass|pwd|login|cred", m[0]) else "secret", value):
                    add([(m.start("v"), m.start("v") + len(value))])

    def _named(self, text: str, at: int) -> tuple[str, str, bool]:
        """What the names to the left promise of a literal at that place, the nearest name, and whether it is assigned or passed.

        Names are read from the nearest one outwards. Names that only say "a value" are passed over, and so is one quoted
        literal of a pair; a name that promises nothing ends the search. A literal whose line names nothing belongs to
        the line before where that one is open (ends in an operator or bracket) or names an entry.
        """
        begin = text.rfind("\n", 0, at) + 1
        kind, name, passed, open_ = self._names_in(text[max(begin, at - REACH) : at])
        for _ in range(3):
            if not open_ or begin == 0:
                break
            end, begin = begin - 1, text.rfind("\n", 0, begin - 1) + 1
            before = text[max(begin, end - REACH) : end].rstrip()
            if entry := ENTRY.search(before):
                return context(entry["name"]), name or entry["name"], True
            if not OPEN_END.search(before):
                break
            kind, more, _, open_ = self._names_in(text[max(begin, at - REACH) : at])
            name = name or more
        return kind, name, passed  # a literal whose own line has no name counts as an element, not as assigned

    def _names_in(self, left: str) -> tuple[str, str, bool, bool]:
        """Kind, nearest name, whether it assigns or passes, and whether no name of the line decided."""
        stop, nearest, pair, passed, steps = len(left), "", False, False, 0
        for m in reversed(list(WORD.finditer(left))):
            glue = left[m.end() : stop]
            if ";" in glue or (")" in glue and not re.search(r"\|\||\?\?|\)\s*$|==|=", glue)):
                return "", nearest, passed, False
            quoted = m.start() > 0 and left[m.start() - 1] in "\"'`" and glue[:1] in ("\\", '"', "'", "`")
            if not nearest:
                passed = bool(re.search(r"[=:(,{\[+|?>!]", glue))
                if not passed and not glue.isspace():
                    return "", m[0], False, False
            words = name_words(m[0])
            kind = context(m[0])
            stop, steps = m.start(), steps + 1
            if kind:
                strong = re.search(r"[=:(,{\[+|?>!]", glue) or nearest
                if pair and kind == "secret" and {"auth"}.intersection(words):
                    kind = "password"
                return (kind if strong else ""), nearest or m[0], passed, False
            if pair and OPENING.search(m[0]):
                return "password", nearest, passed, False
            if quoted and not pair and re.match(r"\\?[\"'`]\s*,", glue):  # the first of a pair
                pair = True
                nearest = nearest or m[0]
                if USERS.intersection(words):
                    rest = left[: m.start()].rstrip("\"'`\\ \t")
                    if rest.endswith(("(", "[", "{")):
                        call = WORD.findall(rest)
                        inner = context(call[-1]) if call else ""
                        return ("pair" if not inner and not (call and OPENING.search(call[-1])) else "password"), nearest, passed, False
                continue
            if words and not NEUTRAL.issuperset(words):
                return "", nearest or m[0], passed, False
            nearest = nearest or m[0]
            if steps > 6:
                return "", nearest, passed, False
        return "", nearest, passed, True

    def _remark(self, text: str, a: int, b: int) -> bool:
        """Whether a comment behind the literal, or alone on the line before, speaks of a credential."""
        end = text.find("\n", b)
        end = len(text) if end < 0 else end
        behind = REMARK.search(text, b, min(end, b + REACH))
        begin = text.rfind("\n", 0, a) + 1
        above = REMARK_LINE.match(text, text.rfind("\n", 0, max(begin - 1, 0)) + 1, max(begin - 1, 0)) if begin else None
        return any(m is not None and context("_".join(w for w in re.findall(r"[A-Za-z]+", m[1]) if w.lower() not in OTHER_WORDS)) in ("password", "secret") for m in (behind, above))

    def _explained(self, value: str) -> bool:
        """Whether a value can be told without segmentation to be no credential: no digit, and words of the dictionary or a sentence."""
        if DIGIT.search(value):
            return False
        if SPACE.search(value):
            return True
        return sum(len(w) for w in LETTERS.findall(value) if w.lower() not in self.seg.cost) < 5

    def _literals(self, text: str, add, at: int = 0, until: int | None = None, depth: int = 0) -> None:
        """Every quoted literal, scored by its residual against what the words on both sides of it promise; then those within it."""
        until = len(text) if until is None else until
        spent = -1  # end of the parts that a literal before was joined with; each of them is then judged alone
        while (m := LITERAL.search(text, at, until)) is not None:
            value, span = m["v"], m.span("v")
            closed = m.end() > span[1]
            if not closed and re.search(r"[\"'`\s]", value):
                at = span[0]
                continue
            at = m.end() if closed else span[1]
            if "\n" in value and not WRAP.search(value):
                at = span[0]
                continue
            if depth < 2 and QUOTE.search(value):
                self._literals(text, add, *span, depth + 1)
            joined = closed and m.start() >= spent and text[m.end() : m.end() + 1] in JOINABLE and JOIN.match(text, m.end(), until) is not None
            if not joined and (len(value) < 4 or self._explained(value)):
                continue
            if closed and IS_KEY.match(text, m.end()) and "?" not in text[max(0, m.start() - REACH) : m.start()].rpartition("\n")[2]:
                continue
            if joined and value[:7].strip().lower() in ("bearer", "basic", "token") and (parts := self._parts(text, m.end())):
                whole, spent = "".join(text[x:y] for x, y in parts), parts[-1][1]
                if self.accept("secret", whole):
                    add(parts)
                continue
            if (m["prefix"] and "f" in m["prefix"].lower() and "{" in value) or not value:
                continue
            parts: list[tuple[int, int]] = []
            if wrap := WRAP.search(value):
                parts = [(span[0] + wrap.end(), span[1])]
                span, value = (span[0], span[0] + wrap.start()), value[: wrap.start()] + value[wrap.end() :]
            if closed and not parts:
                listed = JOINED.search(text, max(0, m.start() - 40), m.start()) is not None
                parts = self._parts(text, m.end(), LISTED if listed else None) if joined or listed else []
                spent = parts[-1][1] if parts else spent
                value += "".join(text[x:y] for x, y in parts)
            kind, name, passed = self._named(text, m.start())
            if not kind and closed and (after := COMPARED.match(text, m.end())):
                kind = context(after["name"])
                passed = True
            if kind == "pair":
                if re.search(r"[a-z]", value) and DIGIT.search(value) and re.search(r"[A-Z]|[^\w.\-:/]", value) and self.accept("password", value):
                    add([span, *parts])
                continue
            if kind:
                if self.accept(kind, value):
                    add([span, *parts])
                continue
            if len(value) < 12 or SPACE.search(value):
                continue
            if PUBLIC_WORDS.intersection(name_words(name)) or not mixed(value) or HASHED.fullmatch(value):
                continue
            if passed and self.seg.residual(value) >= UNNAMED_RESIDUAL and self.accept("key", value):
                add([span, *parts])
            elif passed and self._remark(text, m.start(), m.end()) and self.accept("remark", value):
                add([span, *parts])

    def _bare(self, text: str, add) -> None:
        """Values without quotes behind a name that promises a credential: assignments, entries, elements, block scalars."""
        at = 0
        while (m := NAMED.search(text, at)) is not None:
            at = m.end("name")
            kind = context(m["name"])
            if not kind:
                continue
            v = VALUE.match(text, m.end())
            if v is None:
                continue
            operator = m["op"].strip()
            value = v[0].rstrip(".,;")
            if m["op"].endswith(">"):  # an element: up to the next mark
                value = value.split("<")[0]
            elif operator in (":", "=") and (tag := re.search(r"</|&quot;", value)):
                value = value[: tag.start()]
            span = (v.start(), v.start() + len(value))
            following = text[span[1] : span[1] + 1]
            if following in ("(", "[") or (following == "{" and not value.endswith("$")):
                continue
            if operator == "" and not (mixed(value) or DIGIT.search(value) and re.search(r"[^\w.\-/]", value)):
                continue
            if re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+\d*|[A-Za-z_]\w*(?:\.\w+)+|\d[\d.]*", value) and self.seg.residual(value) < 12:
                continue
            if kind != "password" and re.fullmatch(r"[A-Za-z_][\w.]*", value) and self.seg.residual(value) < 10:
                continue
            if len(value) >= 6 and self.accept(kind, value):
                add([span])
                at = max(at, span[1])
        for m in NAMED_ENTRY.finditer(text):
            kind = context(m["name"])
            value = m["v"].rstrip(",;")
            if kind and len(value) >= 6 and self.accept(kind, value):
                add([(m.start("v"), m.start("v") + len(value))])

    def _unnamed(self, text: str, add) -> None:
        """Bare values that nothing explains, under any name but those of public values."""
        for m in UNNAMED.finditer(text):
            value, before = m["v"], NAME_BEFORE.search(text[max(0, m.start() - 120) : m.start()])
            if before is None or PUBLIC_WORDS.intersection(name_words(before["name"])) or HASHED.fullmatch(value) or not mixed(value):
                continue
            if self.seg.residual(value) >= UNNAMED_RESIDUAL and self.accept("key", value):
                add([m.span("v")])


def mixed(value: str) -> bool:
    return bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and DIGIT.search(value))


def dictionary(chunks: DataFrame, column: str = "content", kept: int = WORDS_KEPT) -> dict[str, int]:
    """Words of the whole corpus with the number of rows they occur in, at most kept, the most frequent.

    A word stands in more rows than a random run of as many letters would if every row had RANDOM_LETTERS of them; rarer
    ones are mostly fragments of random text. Rows are counted within Arrow batches first, so that the shuffle sees each
    word once for each batch; what comes to the driver is bounded by kept, however many partitions there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(r"[A-Z]?[a-z]{2,19}|[A-Z]{3,20}").findall
        for batch in batches:
            counts: Counter[str] = Counter({"": batch.num_rows})
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update({w.lower() for w in set(find(text))})
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    words = chunks.select(column).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3 or word = ''")
    words = stored(words, "words")
    total = words.where("word = ''").agg(F.sum("n")).first()[0] or 0
    by_chance = F.lit(float(total) * RANDOM_LETTERS) / F.pow(F.lit(26.0), F.length("word"))
    rows = most_frequent(words.where(F.col("word") != "").where(F.col("n") >= by_chance), "n", kept).collect()
    return {r["word"]: r["n"] for r in rows}


_FINDERS: dict[int, Finder] = {}


def _finder(shared) -> Finder:
    if shared.id not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[shared.id] = Finder(shared.value)
    return _FINDERS[shared.id]


class _Shared:
    """A broadcast with a stable id for the workers' cache."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _shared(chunks: DataFrame) -> _Shared:
    spark = chunks.sparkSession
    words = dictionary(chunks)
    return _Shared(spark.sparkContext.broadcast(words), hash(tuple(sorted(words.items()))))


def credential_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no): lines, counted from 1, on which a credential value begins."""
    shared = _shared(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in batches:
            ids, lines = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = finder.find(text)
                if values:
                    ends = [m.start() for m in re.finditer("\n", text)]
                    for at in sorted({bisect_right(ends, _begin(text, v) - 1) + 1 for v in values}):
                        ids.append(key)
                        lines.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], names=["chunk_id", "line_no"])

    return chunks.select("chunk_id", "content").mapInArrow(run, "chunk_id bigint, line_no int").distinct()


def _begin(text: str, spans: list[tuple[int, int]]) -> int:
    """Where the value begins: for a private key its opening line."""
    at = spans[0][0]
    opening = text.rfind("-----BEGIN ", 0, at)
    if opening >= 0 and "-----END " not in text[opening:at] and PEM.match(text, opening):
        return opening
    return at


def masked_contents(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content): the content of every row with credential values masked, all else unchanged."""
    shared = _shared(chunks)

    def mask(finder: Finder, text: str | None) -> str | None:
        values = finder.find(text)
        if not values:
            return text
        out, at = [], 0
        for a, b in sorted(span for spans in values for span in spans):
            if a < at or text.startswith("-----BEGIN", a):
                continue
            out += [text[at:a], re.sub(r"[^\n\\]", "x", text[a:b])]
            at = b
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in batches:
            done = pa.array([mask(finder, t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), done], names=["chunk_id", "content"])

    return chunks.select("chunk_id", "content").mapInArrow(run, "chunk_id bigint, content string")
