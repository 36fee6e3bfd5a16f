"""Natural boundaries of a text by the suffix of its file: where definitions, headings and keys begin.

A scanner for each language marks strings and comments first, so that what stands inside them makes no boundary. Comment,
decorator and annotation lines directly above a definition, at its indentation, belong to it.
"""

from __future__ import annotations

import re
from bisect import bisect_right

C_COMMENT = r"(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))"
HASH_COMMENT = r"(?P<c>(?:(?<=\s)|(?<![^\n]))#[^\n]*)"

SCANNERS = {
    ".py": re.compile(
        r"(?P<c>#[^\n]*)|(?P<s>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^\\']|\\.|'(?!''))*(?:'''|\Z)"
        r"|\"(?:[^\\\"\n]|\\.)*\"?|'(?:[^\\'\n]|\\.)*'?))",
        re.S,
    ),
    ".js": re.compile(
        C_COMMENT + r"|(?P<s>\"(?:[^\\\"\n]|\\.)*\"?|'(?:[^\\'\n]|\\.)*'?"
        r"|`(?:[^\\`$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^\\`]|\\.)*`|\{[^{}]*\})*\}|\$)*(?:`|\Z))"
        r"|(?P<r>(?:[(,=:\[!&|?{};+\-*%<>~^]|\breturn\b|\btypeof\b|\bcase\b)[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)",
        re.S,
    ),
    ".go": re.compile(C_COMMENT + r"|(?P<s>\"(?:[^\\\"\n]|\\.)*\"?|'(?:[^\\'\n]|\\.)*'?|`[^`]*(?:`|\Z))", re.S),
    ".java": re.compile(C_COMMENT + r"|(?P<s>\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*(?:\"\"\"|\Z)|\"(?:[^\\\"\n]|\\.)*\"?|'(?:[^\\'\n]|\\.)*'?)", re.S),
    ".sh": re.compile(
        HASH_COMMENT + r"|(?P<h><<-?[ \t]*(?P<hq>[\"'\\]?)(?P<tag>[A-Za-z_]\w*)(?P=hq)?[^\n]*\n(?:(?![ \t]*(?P=tag)[ \t]*(?:\r?\n|\Z))[^\n]*(?:\n|\Z))*)"
        r"|(?P<s>\\.|\"(?:[^\\\"]|\\.)*(?:\"|\Z)|'[^']*(?:'|\Z))",
        re.S,
    ),
    ".yaml": re.compile(HASH_COMMENT + r"|(?P<s>(?<=[\s\[{,:])\"(?:[^\\\"]|\\.)*\"|(?<=[\s\[{,:])'(?:[^']|'')*')", re.S),
}
SCANNERS[".ts"] = SCANNERS[".js"]
SCANNERS[".yml"] = SCANNERS[".yaml"]

EXPORT = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
NESTED = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
SCRIPT = re.compile(
    rf"{EXPORT}(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<f>[\w$]*)|{EXPORT}(?:abstract[ \t]+)?class\b[ \t]*(?P<k>[\w$]*)|{EXPORT}interface[ \t]+(?P<i>[\w$]+)"
    rf"|(?:export[ \t]+)?const[ \t]+(?P<a>[\w$]+)\s*(?::(?:[^=\n]|=>)*)?=\s*(?:async\b\s*)?(?:function\b|(?:<[^<>()]*>\s*)?(?:{NESTED}\s*(?::[^=;{{]*?)?|[\w$]+)\s*=>)"
)
DEFINITIONS = {
    ".py": re.compile(r"(?:async[ \t]+def|def|class)[ \t]+(?P<n>\w+)"),
    ".js": SCRIPT,
    ".ts": SCRIPT,
    ".go": re.compile(r"func[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<f>\w*)|type\b[ \t]*(?P<t>\w*)"),
    ".sh": re.compile(r"(?:function[ \t]+(?P<k>[\w:.\-]+)[ \t]*(?:\([ \t]*\))?|(?P<n>[A-Za-z_][\w:.\-]*)[ \t]*\([ \t]*\))\s*(?:\{|\(|$)", re.M),
    ".yaml": re.compile(r"(?P<n>\"[^\"\n]*\"|'[^'\n]*'|[^\s#\-&*!|>%@`\"'{}\[\],?:][^#\n:]*|-[^\s#\n:][^#\n:]*)[ \t]*:(?:[ \t]|\r?$)", re.M),
}
DEFINITIONS[".yml"] = DEFINITIONS[".yaml"]
MODIFIER = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+)*"
TYPE = r"[\w$.]+(?:\s*<[^;{}()]*?>)?(?:\s*\[\s*\])*"
JAVA_CLASS = re.compile(rf"{MODIFIER}(?:class|interface|enum|record|@interface)\s+(?P<n>[\w$]+)")
JAVA_METHOD = re.compile(
    rf"(?P<mod>{MODIFIER})(?:<[^;{{}}()]*?>\s+)?(?:(?P<type>{TYPE})\s+)?(?P<n>[\w$]+)\s*\((?P<args>(?:[^()]|\([^()]*\))*)\)\s*(?:\[\s*\]\s*)*(?:throws\s+[\w$.,\s]+?)?(?:default\s+[^;]+?)?(?P<end>[{{;])"
)
NOT_METHODS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw", "else", "do", "try", "assert", "yield", "super", "this", "case"}


class Text:
    """A text with its line starts and the spans of strings and comments."""

    def __init__(self, text: str, suffix: str):
        self.text, self.suffix = text, suffix
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.spans: list[tuple[int, int, bool]] = []  # begin, end, is a comment
        scanner = SCANNERS.get(suffix)
        if scanner:
            for m in scanner.finditer(text):
                if m.lastgroup == "r":
                    a = text.index("/", m.start())
                    self.spans.append((a, m.end(), False))
                elif m.groupdict().get("h"):
                    self.spans.append((text.index("\n", m.start()), m.end(), False))
                else:
                    self.spans.append((m.start(), m.end(), m["c"] is not None))
        self.begins = [s[0] for s in self.spans]

    def span_at(self, at: int) -> tuple[int, int, bool] | None:
        k = bisect_right(self.begins, at) - 1
        return self.spans[k] if k >= 0 and at < self.spans[k][1] else None

    def inside(self, at: int) -> bool:
        """Whether the line that starts at this offset starts within a string or comment."""
        k = bisect_right(self.begins, at - 1) - 1
        return k >= 0 and self.spans[k][0] < at < self.spans[k][1]

    def line(self, k: int) -> str:
        end = self.starts[k + 1] - 1 if k + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[k] : end].rstrip("\r")

    def blanked(self) -> str:
        out, at = [], 0
        for a, b, _ in self.spans:
            if a < at:
                continue
            out += [self.text[at:a], re.sub(r"[^\n]", " ", self.text[a:b])]
            at = b
        return "".join(out) + self.text[at:]

    def _comment_line(self, k: int, indent: str) -> int | None:
        """First line of the comment that ends line k, if nothing but a comment at that indentation stands there."""
        line = self.line(k)
        body = line.strip()
        if not body:
            return None
        span = self.span_at(self.starts[k] + len(line) - len(line.lstrip()))
        if span is None or not span[2] or span[1] < self.starts[k] + len(line.rstrip()):
            return None
        first = bisect_right(self.starts, span[0]) - 1
        lead = self.text[self.starts[first] : span[0]]
        return first if lead == indent else None

    def lead(self, k: int) -> int:
        """The first of the comment, decorator and annotation lines directly above line k."""
        line = self.line(k)
        indent = line[: len(line) - len(line.lstrip())]
        while k > 0:
            above = self.line(k - 1)
            if not above.strip():
                break
            first = self._comment_line(k - 1, indent)
            if first is not None:
                k = first
                continue
            if self.suffix not in (".py", ".js", ".ts", ".java"):
                break
            at = k - 1
            while at >= 0 and k - 1 - at < 200 and self.line(at).strip() and not self.line(at).startswith(indent + "@"):
                at -= 1
            if at < 0 or not self.line(at).startswith(indent + "@") or self.inside(self.starts[at]):
                break
            between = self.blanked()[self.starts[at] : self.starts[k]]
            opened = sum(between.count(c) for c in "([{") - sum(between.count(c) for c in ")]}")
            depth, closed_early = 0, False
            for ch, nxt in zip(between, between[1:] + " ", strict=True):
                depth += (ch in "([{") - (ch in ")]}")
                if depth == 0 and ch == "\n" and nxt not in (" ", "\t", "@") and nxt.strip() and not between.rstrip().endswith(ch):
                    closed_early = True
            rest = [x for x in between.split("\n")[1:] if x.strip()]
            if opened != 0 or (rest and closed_early):
                break
            if rest and between.split("\n")[0].count("(") == between.split("\n")[0].count(")"):
                if not rest[0].lstrip().startswith("@"):
                    break
            k = at
        return k


def markdown(text: str) -> list[tuple[int, str]]:
    found, fence, comment, before = [], "", False, ""
    for k, line in enumerate(text.split("\n")):
        line = line.rstrip("\r")
        body = line.lstrip(" ")
        shallow = len(line) - len(body) < 4
        m = re.match(r"(`{3,}|~{3,})(.*)", body) if shallow else None
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            before = ""
            continue
        if comment:
            comment = "-->" not in line
            before = ""
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, before = m[1], ""
            continue
        if body.startswith("<!--") and "-->" not in body:
            comment, before = True, ""
            continue
        if shallow and (h := re.match(r"#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", body)):
            found.append((k, h[1] or ""))
            before = ""
            continue
        if shallow and before and re.match(r"(?:=+|-+)[ \t]*$", body):
            found.append((k - 1, before))
            before = ""
            continue
        before = body if shallow and body.strip() and not re.match(r"(?:[-*+]|\d+[.)])[ \t]|>|\||[-*_ \t]+$", body) else ""
    return found


def java(t: Text) -> list[tuple[int, str]]:
    text = t.blanked()
    found: list[tuple[int, str]] = []
    stack: list[str] = []
    statement = 0  # where the declaration or statement under way begins
    at = 0
    for m in re.finditer(r"[{};]", text):
        ch = m[0]
        if ch == "}":
            if stack:
                stack.pop()
            statement = m.end()
            continue
        head = text[statement : m.end()]
        begin = statement + len(head) - len(head.lstrip())
        plain = re.match(r"(?:\s*@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?)*\s*", head)
        start = statement + (plain.end() if plain else 0)
        rest = text[start : m.end()]
        in_class = not stack or stack[-1] == "class"
        kind = "block"
        if in_class and (c := JAVA_CLASS.match(rest)) and ch == "{":
            kind = "class"
            found.append((begin if t.text[begin] == "@" else start, c["n"]))
        elif in_class and (c := JAVA_METHOD.fullmatch(rest.rstrip())) and c["n"] not in NOT_METHODS:
            first = (c["type"] or "").split("<")[0].strip()
            constructor = not c["type"] and ch == "{" and c["n"][:1].isupper()
            if (c["type"] and first not in NOT_METHODS and (ch == "{" or (stack and "=" not in rest))) or constructor:
                found.append((begin if t.text[begin] == "@" else start, c["n"]))
        if ch == "{":
            stack.append(kind)
        statement = m.end()
        at = m.end()
    del at
    return [(bisect_right(t.starts, a) - 1, n) for a, n in found]


def boundaries(text: str, suffix: str) -> list[tuple[int, str]]:
    """(line from 0, name of what begins there), ascending; the first line always, with an empty name if nothing does."""
    found: dict[int, str] = {0: ""}
    if suffix in (".md", ".markdown"):
        for k, name in markdown(text):
            found[k] = name
    elif suffix == ".java":
        t = Text(text, suffix)
        for k, name in java(t):
            found.setdefault(t.lead(k), name)
            if t.lead(k) == 0:
                found[0] = name
    elif suffix in DEFINITIONS:
        t, pattern = Text(text, suffix), DEFINITIONS[suffix]
        source = t.blanked() if suffix in (".js", ".ts") else text
        for k, at in enumerate(t.starts):
            if at >= len(text) or text[at] in " \t\r\n" or t.inside(at):
                continue
            m = pattern.match(source, at)
            if m and (suffix not in (".yaml", ".yml") or not text.startswith(("---", "..."), at)):
                name = next((v for v in m.groupdict().values() if v), "")
                first = t.lead(k)
                if first == 0 or first not in found:
                    found[first] = name.strip("\"' ")
    return sorted(found.items())
