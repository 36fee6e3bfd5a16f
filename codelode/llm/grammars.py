"""Token streams and grammars of the languages whose files are checked.

The grammars take everything the languages allow and a little more: precedence, contexts of keywords such as break, and
whatever names mean are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .derivatives import Grammar


class Fault(Exception):
    """A token that no language has; the offset in the text."""


BOM = chr(0xFEFF)


def _words(s: str) -> tuple[str, ...]:
    return tuple(s.split())


# ---------------------------------------------------------------- JSON

JSON_TOKEN = re.compile(r"""[ \t\r\n]*(?:(?P<p>[{}\[\],:])|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<w>true\b|false\b|null\b)|(?P<e>\Z)|(?P<bad>.))""", re.S)


def json_tokens(text: str) -> tuple[list[str], list[int]]:
    out, at = [], []
    for m in JSON_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "p":
            out.append(m["p"])
        elif kind == "s":
            out.append("S")
        elif kind == "e":
            break
        elif kind == "bad":
            raise Fault(m.start("bad"))
        else:
            out.append("V")
        at.append(m.start(kind))
    return out, at


JSON = """
value: '{' (member (',' member)*)? '}' | '[' (value (',' value)*)? ']' | S | V
member: S ':' value
"""

# ---------------------------------------------------------------- Python

PY_KEYWORDS = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
)
PY_TOKEN = re.compile(
    r"""[ \t\f]*(?:\\\r?\n[ \t\f]*)*(?:
    (?P<s>(?:[rRuU]|[bB][rR]?|[rR][bB]|[fFtT][rR]?|[rR][fFtT])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\\\"\r\n]|\\(?:\r\n|.))*\"|'(?:[^\\'\r\n]|\\(?:\r\n|.))*'))
    |(?P<i>[^\W\d]\w*)
    |(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))
    |(?P<l>\r?\n|\r)
    |(?P<c>\#[^\r\n]*)
    |(?P<p>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=])
    |(?P<e>\Z)|(?P<bad>.))""",
    re.S | re.X,
)
PY_OPEN, PY_CLOSE = frozenset("([{"), frozenset(")]}")


def python_tokens(text: str) -> tuple[list[str], list[int]]:
    out: list[str] = []
    at: list[int] = []
    if "\0" in text:
        raise Fault(text.index("\0"))
    keywords = frozenset(PY_KEYWORDS)
    depth, indents, fresh = 0, [0], True
    for m in PY_TOKEN.finditer(text.removeprefix(BOM)):
        kind = m.lastgroup
        pos = m.start(kind)
        if kind == "c":
            continue
        if kind == "l":
            if not depth and not fresh:
                out.append("NL")
                at.append(pos)
                fresh = True
            continue
        if kind == "e":
            break
        if kind == "bad":
            raise Fault(pos)
        if fresh and not depth:
            fresh = False
            column = 0
            for ch in text[text.rfind("\n", 0, pos) + 1 : pos]:
                column = (column // 8 + 1) * 8 if ch == "\t" else 0 if ch == "\f" else column + 1
            if column > indents[-1]:
                indents.append(column)
                out.append("IN")
                at.append(pos)
            else:
                while column < indents[-1]:
                    indents.pop()
                    out.append("OUT")
                    at.append(pos)
                if column != indents[-1]:
                    raise Fault(pos)
        if kind == "i":
            word = m["i"]
            out.append(word if word in keywords or word in ("match", "case", "type", "_") else "ID")
        elif kind == "p":
            p = m["p"]
            if p in PY_OPEN:
                depth += 1
            elif p in PY_CLOSE:
                depth = max(0, depth - 1)
            out.append(p)
        else:
            out.append("STR" if kind == "s" else "NUM")
        at.append(pos)
    if depth:
        return out, at  # the text breaks off within brackets
    if not fresh:
        out.append("NL")
        at.append(len(text))
    out += ["OUT"] * (len(indents) - 1)
    at += [len(text)] * (len(indents) - 1)
    return out, at


PYTHON = """
file: (NL | statement)*
statement: simple | compound
simple: small (';' small)* ';'? NL
small: exprs ((':' expr)? ('=' (yield | exprs))* | AUG (yield | exprs)) | yield | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)?
  | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'del' exprs | 'assert' expr (',' expr)?
  | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
  | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')')
  | 'type' NAME typeparams? '=' expr
names: NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dotted: NAME ('.' NAME)*
suite: simple | NL IN statement+ OUT
compound: 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
  | 'while' named ':' suite ('else' ':' suite)?
  | 'async'? 'for' exprs 'in' exprs ':' suite ('else' ':' suite)?
  | 'try' ':' suite (('except' '*'? (expr (',' expr)* ('as' NAME)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
  | 'async'? 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' suite
  | decorator* 'class' NAME typeparams? ('(' args? ')')? ':' suite
  | decorator* 'async'? 'def' NAME typeparams? '(' params? ')' ('->' expr)? ':' suite
  | 'match' exprs ':' NL IN ('case' patterns ('if' named)? ':' suite)+ OUT
decorator: '@' named NL
withitem: expr ('as' operand)?
typeparams: '[' typeparam (',' typeparam)* ','? ']'
typeparam: ('*' | '**')? NAME (':' expr)? ('=' expr)?
params: param (',' param)* ','?
param: NAME (':' expr)? ('=' expr)? | '*' (NAME (':' '*'? expr)?)? | '**' NAME (':' expr)? | '/'
lambdaparams: lambdaparam (',' lambdaparam)* ','?
lambdaparam: NAME ('=' expr)? | '*' NAME? | '**' NAME | '/'
patterns: pattern (',' pattern)* ','?
pattern: ('*' NAME | altpattern ('as' NAME)?)
altpattern: closed ('|' closed)*
closed: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (patternarg (',' patternarg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']'
  | '{' (keypattern (',' keypattern)* ','?)? '}'
patternarg: (NAME '=')? pattern
keypattern: '**' NAME | ('-'? NUM | STR+ | dotted | 'None' | 'True' | 'False') ':' pattern
exprs: star (',' star)* ','?
star: '*' expr | named
named: (NAME ':=')? expr
expr: 'lambda' lambdaparams? ':' expr | test ('if' test 'else' expr)?
test: operand ((BIN | 'not' 'in') operand)*
operand: PRE* primary post*
primary: NAME | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' (yield | exprs | named comp) ')' | '[' ']' | '[' (exprs | star comp) ']'
  | '{' '}' | '{' (exprs | named comp | entry (',' entry)* ','? | expr ':' expr comp) '}'
entry: expr ':' expr | '**' expr
post: '.' NAME | '(' args? ')' | '[' slices ']'
args: arg (',' arg)* ','?
arg: '*' expr | '**' expr | NAME '=' expr | named comp?
slices: slice (',' slice)* ','?
slice: star | expr? ':' expr? (':' expr?)?
comp: ('async'? 'for' exprs 'in' test ('if' compif)*)+
compif: 'lambda' lambdaparams? ':' compif | (NAME ':=')? test
yield: 'yield' ('from' expr | exprs)?
"""

# ---------------------------------------------------------------- JavaScript and TypeScript

JS_KEYWORDS = _words(
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new null return super switch this throw true false try typeof var void while with yield await let static "
    "implements interface package private protected public"
)
JS_CONTEXT = _words("async of get set from as")
TS_CONTEXT = _words("async of get set from as type interface namespace module declare abstract readonly is keyof infer unique asserts satisfies override accessor out global public private protected static package let implements any object")
TEMPLATE = r"`(?:[^\\`$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^\\`]|\\.)*`|\{(?:[^{}`]|`(?:[^\\`]|\\.)*`|\{[^{}]*\})*\})*\})*`"
REGEX = r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*"
JS_TOKEN = re.compile(
    rf"""[ \t\f\v\u00a0\ufeff]*(?:
    (?P<i>\#?[^\W\d][\w$]*|\#?\$[\w$]*)
    |(?P<w>(?P<wo>[(,=:\[!&|?{{;+\-*%<>~^]|=>|\breturn|\btypeof|\bcase)[ \t]*(?P<wr>{REGEX}))
    |(?P<l>(?:\r\n?|[\n\u2028\u2029])\s*)
    |(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|[-+*/%&|^]=|[-+*/%&|^!~<>=()\[\]{{}},:;?@]|\.(?!\d))
    |(?P<n>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))
    |(?P<s>"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')
    |(?P<t>{TEMPLATE})
    |(?P<e>\Z)|(?P<bad>.))""",
    re.S | re.X,
)
JS_COMMENT = re.compile(rf"""//[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/|"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|{TEMPLATE}|(?<=[(,=:\[!&|?;{{}}+]){REGEX}|(?<=[(,=:\[!&|?;{{}}+]\s){REGEX}""", re.S)


def _no_comment(m: re.Match) -> str:
    s = m[0]
    if s.startswith("//"):
        return " " * len(s)
    if s.startswith("/*"):
        return re.sub(r"[^\r\n]", " ", s)
    return s


def script_tokens(text: str, split_greater: bool, keywords: frozenset[str], context: frozenset[str]) -> tuple[list[str], list[int]]:
    if text.startswith("#!"):
        text = " " * len(text.split("\n", 1)[0]) + text[len(text.split("\n", 1)[0]) :]
    if "/" in text:
        text = JS_COMMENT.sub(_no_comment, text)
    out: list[str] = []
    at: list[int] = []
    for m in JS_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "p":
            p = m["p"]
            if p == "}":
                out.append("\0NL")
                at.append(m.start("p"))
            elif split_greater and p[0] == ">" and p != ">":
                out += list(p[:-1])
                at += [m.start("p")] * (len(p) - 1)
                p = p[-1]
            out.append(p)
            at.append(m.start("p"))
            continue
        if kind == "i":
            word = m["i"]
            out.append(word if word in keywords or word in context else "PRIVATE" if word[0] == "#" else "ID")
        elif kind == "l":
            out.append("\0NL")
        elif kind == "wr" or kind == "w":
            op = m["wo"]
            out += [op, "RE"]
            at += [m.start("wo"), m.start("wr")]
            continue
        elif kind == "e":
            break
        elif kind == "bad":
            raise Fault(m.start("bad"))
        else:
            out.append({"n": "NUM", "s": "STR", "t": "TPL"}[kind])
        at.append(m.start(kind))
    out.append("\0NL")
    at.append(len(text))
    return out, at


SCRIPT_STATEMENTS = """
program: statement*
block: '{' statement* '}'
end: ';' | NL
statement: block | ';' | declaration | 'if' '(' expr ')' statement ('else' statement)? | 'for' 'await'? '(' forhead ')' statement
  | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' end? | 'continue' (ID)? end | 'break' (ID)? end | 'return' expr? end | 'throw' expr end
  | 'try' block ('catch' ('(' catchparam ')')? block ('finally' block)? | 'finally' block)
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' statement*)* '}' | 'debugger' end | ID ':' statement | plain end
forhead: (('var' | 'let' | 'const') binder (',' binder)* | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') target ('in' | 'of') expr | operand ('in' | 'of') expr
named: '{' (specifier (',' specifier)* ','?)? '}'
expr: assign (',' assign)*
assign: operand (BIN operand | greater operand | '?' assign ':' assign | '=' assign | AUG assign CAST)* | arrow | 'yield' '*'? assign?
plain: (plainoperand (BIN operand | greater operand | '?' assign ':' assign | '=' assign | AUG assign CAST)* | arrow | 'yield' '*'? assign?) (',' assign)*
greater: '>' | '>' '>' | '>' '>' '>' | '>' '='
operand: PRE operand | primary post*
plainoperand: PRE operand | plainprimary post*
primary: plainprimary | object | function | class
plainprimary: ID | NUM | STR | TPL | RE | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | array | 'import' ('(' expr ')' | '.' NAME) | 'new' '.' NAME
array: '[' ','* (element (','+ element)* ','*)? ']'
element: '...'? assign
args: '(' (element (',' element)* ','?)? ')'
object: '{' (property (',' property)* ','?)? '}'
propname: NAME | STR | NUM | '[' assign ']' | PRIVATE
function: 'async'? 'function' '*'? ID? GENERIC signature block
"""

SCRIPT = (
    SCRIPT_STATEMENTS.replace(" CAST", "").replace("GENERIC ", "")
    + """
declaration: 'async'? 'function' '*'? ID signature block | class | ('var' | 'let') binder (',' binder)* end | 'const' constant (',' constant)* end | import | export
catchparam: target
binder: target ('=' assign)?
constant: target '=' assign
target: ID | array | object
signature: '(' (param (',' param)* ','?)? ')'
param: '...'? target ('=' assign)?
arrow: 'async'? (ID | signature) '=>' (block | assign)
property: propname ':' assign | ID ('=' assign)? | '...' assign | ('async' | 'get' | 'set' | '*')* propname signature block
class: 'class' ID? ('extends' operand)? '{' member* '}'
member: ';' | 'static' block | 'static'? ('async' | 'get' | 'set' | '*')* propname (signature block | ('=' assign)? end)
post: '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | '[' expr ']' | args) | '[' expr ']' | args | TPL | '++' | '--'
specifier: (NAME | STR) ('as' (NAME | STR))?
import: 'import' (STR | (ID (',' (star | named))? | star | named) 'from' STR) ('with' object)? end
star: '*' 'as' ID
export: 'export' ('*' ('as' NAME)? 'from' STR end | named ('from' STR)? end | 'default' (function | class | plain end | object end) | declaration)
"""
)

TYPED = (
    SCRIPT_STATEMENTS.replace(" CAST", "").replace("GENERIC ", "generics? ").replace("operand: PRE operand | primary post*", "operand: PRE operand | '<' type '>' operand | primary post*")
    .replace("BIN operand | greater operand", "BIN operand | greater operand | ('as' | 'satisfies') type")
    + """
declaration: 'async'? 'function' '*'? ID generics? signature (block | end) | decorator* 'abstract'? class | ('var' | 'let' | 'const') binder (',' binder)* end | import | export
  | 'declare' declaration | 'declare' 'global' block | 'interface' ID generics? ('extends' type (',' type)*)? typebody | 'type' ID generics? '=' type end
  | 'const'? 'enum' ID '{' (enumerator (',' enumerator)* ','?)? '}' | ('namespace' | 'module') (ID ('.' ID)* | STR) (block | end)
enumerator: propname ('=' assign)?
decorator: '@' operand NL?
catchparam: target (':' type)?
binder: target '!'? (':' type)? ('=' assign)?
target: ID | array | object
signature: '(' (param (',' param)* ','?)? ')' (':' returned)?
returned: 'asserts'? (ID | 'this') ('is' type)? | type
param: decorator* MODIFIER* '...'? (target | 'this') '?'? (':' type)? ('=' assign)?
arrow: 'async'? (ID | generics? signature) '=>' (block | assign)
property: propname ':' assign | ID ('=' assign)? | '...' assign | ('async' | 'get' | 'set' | '*')* propname generics? signature block
class: 'class' ID? generics? ('extends' operand targs?)? ('implements' type (',' type)*)? '{' member* '}'
member: ';' | 'static' block | decorator* MODIFIER* ('async' | 'get' | 'set' | '*')* propname ('?' | '!')? (generics? signature (block | end) | (':' type)? ('=' assign)? end)
  | MODIFIER* '[' ID ':' type ']' ':' type end
post: '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | '[' expr ']' | targs? args) | '[' expr ']' | targs? args | targs? TPL | '++' | '--' | '!'
specifier: 'type'? (NAME | STR) ('as' (NAME | STR))?
import: 'import' 'type'? (STR | (ID (',' (star | named))? | star | named) 'from' STR) ('with' object)? end | 'import' 'type'? ID '=' (operand) end
star: '*' 'as' ID
export: 'export' ('type'? '*' ('as' NAME)? 'from' STR end | 'type'? named ('from' STR)? end | 'default' (function | 'abstract'? class | declaration | plain end | object end) | declaration | '=' expr end | 'as' 'namespace' ID end)
generics: '<' generic (',' generic)* ','? '>'
generic: ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
targs: '<' type (',' type)* ','? '>'
type: NL? ('|' | '&')? simpletype (NL? ('|' | '&') simpletype)* ('extends' type '?' type ':' type)?
simpletype: ('keyof' | 'readonly' | 'unique' | 'infer' | 'typeof')* basictype ('[' type? ']')*
basictype: entity targs? | STR | '-'? NUM | TPL | 'null' | 'true' | 'false' | 'void' | 'this' | 'import' '(' STR ')' ('.' NAME)* targs? | '(' type ')' | '[' (tupleitem (',' tupleitem)* ','?)? ']' | typebody
  | ('abstract'? 'new')? generics? typesignature '=>' returned
entity: ID ('.' NAME)*
tupleitem: '...'? (ID '?'? ':')? type '?'?
typesignature: '(' (typeparam (',' typeparam)* ','?)? ')'
typeparam: '...'? (target | 'this') '?'? (':' type)?
typebody: '{' (typemember (';' | ',' | NL)*)* '}'
typemember: ('+' | '-')? 'readonly'? (('get' | 'set')? propname '?'? (generics? typesignature)? (':' returned)? | generics? typesignature (':' returned)? | 'new' generics? typesignature (':' type)?
  | '[' ID ':' type ']' ':' type | '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)?)
"""
)
JS_BIN = _words("+ - * / % ** << < <= == != === !== & | ^ && || ?? in instanceof")
JS_AUG = _words("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")
JS_PRE = _words("! ~ + - ++ -- typeof void delete await new")
TS_MODIFIER = _words("public private protected static readonly abstract override declare accessor async")

# ---------------------------------------------------------------- Go
# The package clause may be missing: a file of nothing but declarations passes.

GO_KEYWORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
GO_TOKEN = re.compile(
    r"""[ \t\f]*(?:
    (?P<i>[^\W\d]\w*)
    |(?P<l>\r?\n|\r)
    |(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<p>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^!~<>=()\[\]{},:;]|\.(?!\d))
    |(?P<n>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(?P<s>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{3}|x..|u.{4}|U.{8}|.))')
    |(?P<e>\Z)|(?P<bad>.))""",
    re.S | re.X,
)
GO_ENDS = frozenset(("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


def go_tokens(text: str) -> tuple[list[str], list[int]]:
    out: list[str] = []
    at: list[int] = []
    keywords = frozenset(GO_KEYWORDS)
    for m in GO_TOKEN.finditer(text.removeprefix(BOM)):
        kind = m.lastgroup
        if kind == "i":
            word = m["i"]
            out.append(word if word in keywords else "ID")
        elif kind == "l" or (kind == "c" and "\n" in m["c"]):
            if not out or out[-1] not in GO_ENDS:
                continue
            out.append(";")
        elif kind == "c":
            continue
        elif kind == "p":
            p = m["p"]
            if p in ("}", ")"):
                out.append("\0;")
                at.append(m.start("p"))
            out.append(p)
        elif kind == "e":
            break
        elif kind == "bad":
            raise Fault(m.start("bad"))
        else:
            out.append("NUM" if kind == "n" else "STR")
        at.append(m.start(kind))
    if out and out[-1] in GO_ENDS:
        out.append(";")
        at.append(len(text))
    return out, at


GO = """
file: ('package' ID ';')? ('import' (importspec | '(' (importspec ';')* ')') ';')* (toplevel ';')*
importspec: ('.' | ID)? STR
toplevel: declaration | 'func' receiver? ID tparams? signature block?
receiver: '(' params? ')'
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ID (',' ID)* constraint
constraint: '~'? type ('|' '~'? type)*
declaration: 'const' (constspec | '(' (constspec ';')* ')') | 'var' (varspec | '(' (varspec ';')* ')') | 'type' (typespec | '(' (typespec ';')* ')')
constspec: ids (type? '=' exprs)?
varspec: ids (type ('=' exprs)? | '=' exprs)
typespec: ID tparams? '='? type
ids: ID (',' ID)*
signature: '(' params? ')' result?
result: type | '(' params? ')'
params: param (',' param)* ','?
param: '...'? type | ID '...'? type
type: ID ('.' ID)? ('[' type (',' type)* ','? ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' signature | '(' type ')'
  | 'struct' '{' (field ';')* '}' | 'interface' '{' (imember ';')* '}'
field: (ids type | '*'? ID ('.' ID)? ('[' type (',' type)* ']')?) STR?
imember: ID signature | constraint
block: '{' statements '}'
statements: (statement? ';')* 
statement: declaration | ID ':' statement? | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for
simple: exprs (('=' | ':=' | AUG) exprs | '++' | '--' | '<-' expr)?
if: 'if' (simple? ';')? expr block ('else' (if | block))?
switch: 'switch' (simple? ';')? simple? '{' (('case' cases | 'default') ':' statements)* '}'
cases: (expr | type) (',' (expr | type))*
select: 'select' '{' (('case' simple | 'default') ':' statements)* '}'
for: 'for' (simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr | expr)? block
exprs: expr (',' expr)*
expr: operand (BIN operand)*
operand: PRE* primary post*
primary: ID | NUM | STR | '(' (expr | type) ')' | 'func' signature block | littype literal | conversion
littype: '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* '}'
conversion: '[' ']' type | 'map' '[' type ']' type | 'chan' type | '<-' 'chan' type | 'interface' '{' (imember ';')* '}' | 'struct' '{' (field ';')* '}'
literal: '{' (item (',' item)* ','?)? '}'
item: (itemvalue ':')? itemvalue
itemvalue: expr | literal
post: '.' (ID | '(' (type | 'type') ')') | '[' index ']' | '(' (arg (',' arg)* '...'? ','?)? ')' | literal
arg: expr | type
index: (expr | type) (',' (expr | type))* ','? | expr? ':' expr? (':' expr?)?
"""

# ---------------------------------------------------------------- Java

JAVA_KEYWORDS = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
)
JAVA_CONTEXT = _words("record sealed permits var yield when")
JAVA_TOKEN = re.compile(
    r"""[ \t\f\r\n]*(?:
    (?P<i>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<p>\.\.\.|->|::|<<=|&&|\|\||\+\+|--|==|!=|<=|<<|[-+*/%&|^]=|[-+*/%&|^!~<>=()\[\]{},:;?@]|\.(?!\d))
    |(?P<n>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
    |(?P<s>\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))')
    |(?P<e>\Z)|(?P<bad>.))""",
    re.S | re.X,
)


def java_tokens(text: str) -> tuple[list[str], list[int]]:
    out: list[str] = []
    at: list[int] = []
    known = frozenset(JAVA_KEYWORDS + JAVA_CONTEXT)
    for m in JAVA_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "p":
            out.append(m["p"])
        elif kind == "i":
            word = m["i"]
            out.append(word if word in known else "ID")
        elif kind == "c":
            continue
        elif kind == "e":
            break
        elif kind == "bad":
            raise Fault(m.start("bad"))
        else:
            out.append("NUM" if kind == "n" else "STR")
        at.append(m.start(kind))
    return out, at


JAVA = """
file: (annotation* 'package' dotted ';')? ('import' 'static'? dotted ('.' '*')? ';' | ';')* (typedecl | ';')*
dotted: ID ('.' ID)*
annotation: '@' dotted ('(' (annotationarg (',' annotationarg)* ','?)? ')')?
annotationarg: ID '=' value | value
value: assign | annotation | '{' (value (',' value)*)? ','? '}'
modifiers: (annotation | MODIFIER)*
typedecl: modifiers (class | interface | enum | record | annotationtype)
class: 'class' ID generics? ('extends' type)? ('implements' types)? ('permits' types)? '{' member* '}'
interface: 'interface' ID generics? ('extends' types)? ('permits' types)? '{' member* '}'
enum: 'enum' ID ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant: annotation* ID args? ('{' member* '}')?
record: 'record' ID generics? '(' params? ')' ('implements' types)? '{' member* '}'
annotationtype: '@' 'interface' ID '{' member* '}'
member: ';' | 'static'? block | typedecl | modifiers (generics annotation*)? (type declarators ';' | rettype ID '(' params? ')' dims ('throws' types)? (block | ('default' value)? ';') | ID ('(' params? ')')? ('throws' types)? block)
rettype: type | 'void'
types: type (',' type)*
type: annotation* (PRIMITIVE | ID targs? ('.' annotation* ID targs?)*) dims
dims: (annotation* '[' ']')*
generics: '<' generic (',' generic)* '>'
generic: annotation* ID ('extends' type ('&' type)*)?
targs: '<' (targ (',' targ)*)? '>'
targ: type | annotation* '?' (('extends' | 'super') type)?
params: param (',' param)*
param: modifiers type (annotation* '...')? (ID | 'this') dims | modifiers type ('.' 'this')
declarators: declarator (',' declarator)*
declarator: ID dims ('=' initial)?
initial: assign | arrayinit
arrayinit: '{' (initial (',' initial)*)? ','? '}'
block: '{' statement* '}'
statement: block | ';' | modifiers type declarators ';' | typedecl | 'if' '(' assign ')' statement ('else' statement)? | 'while' '(' assign ')' statement | 'do' statement 'while' '(' assign ')' ';'
  | 'for' '(' (modifiers type ID ':' assign | (modifiers type declarators | exprs)? ';' assign? ';' exprs?) ')' statement
  | 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' modifiers type ('|' type)* ID ')' block)* ('finally' block)?
  | switch | 'return' assign? ';' | 'throw' assign ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' assign ';' | 'assert' assign (':' assign)? ';' | 'synchronized' '(' assign ')' block | ID ':' statement | assign ';'
resource: modifiers type ID '=' assign | assign
switch: 'switch' '(' assign ')' '{' (caselabel (':' statement* | '->' (assign ';' | block | 'throw' assign ';')))* '}'
caselabel: 'case' caseitem (',' caseitem)* ('when' assign)? | 'default'
caseitem: ternary | pattern | 'default'
pattern: modifiers type ID | type '(' (pattern (',' pattern)*)? ')' ID?
exprs: assign (',' assign)*
assign: lambda | ternary (('=' | AUG | '>' '>' '=' | '>' '>' '>' '=') assign)?
lambda: (ID | '(' (params | ID (',' ID)*)? ')') '->' (block | assign)
ternary: binary ('?' (ternary | lambda) ':' (ternary | lambda))?
binary: operand ((BIN | greater) operand | 'instanceof' ('final'? type ID? | pattern))*
greater: '>' | '>' '=' | '>' '>' | '>' '>' '>'
operand: PRE operand | '(' type ('&' type)* ')' (castoperand | lambda) | primary post*
castoperand: PRE operand | '(' type ('&' type)* ')' castoperand | primary post*
primary: ID | NUM | STR | 'this' | 'super' | 'true' | 'false' | 'null' | '(' assign ')' | 'new' creator | switch | PRIMITIVE dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | ID targs? ('.' ID targs?)* dims ('.' 'class' | '::' (ID | 'new')) | annotation
creator: targs? annotation* (PRIMITIVE | ID targs? ('.' ID targs?)*) (('[' assign ']')+ ('[' ']')* | ('[' ']')+ arrayinit | args ('{' member* '}')?)
args: '(' exprs? ')'
post: '.' targs? (ID args? | 'this' | 'class' | 'super' args? | 'new' creator) | args | '[' assign ']' | '++' | '--' | '::' targs? (ID | 'new')
"""

# ---------------------------------------------------------------- POSIX shell

SH_RESERVED = _words("if then else elif fi for in do done while until case esac { } !")
SH_OPERATOR = re.compile(r"&&|\|\||;;&|;;|;&|<<-|<<|>>|<&|>&|<>|>\||[&|;<>()\n]")
SH_PLAIN = re.compile(r"[^\s\\'\"`$&|;<>()#]+")


def _sh_double(text: str, i: int) -> int:
    """End of a double-quoted string that begins at i."""
    n, k = len(text), i + 1
    while k < n:
        c = text[k]
        if c == "\\":
            k += 2
        elif c == '"':
            return k + 1
        elif c == "$":
            k = _sh_dollar(text, k)
        elif c == "`":
            k = _sh_back(text, k)
        else:
            k += 1
    raise Fault(i)


def _sh_back(text: str, i: int) -> int:
    k = i + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
        elif text[k] == "`":
            return k + 1
        else:
            k += 1
    raise Fault(i)


def _sh_dollar(text: str, i: int) -> int:
    n = len(text)
    if text.startswith("$((", i):
        depth, k = 2, i + 3
        while k < n and depth:
            depth += (text[k] == "(") - (text[k] == ")")
            k += 1
        if not depth:
            return k
        raise Fault(i)
    if text.startswith("$(", i):
        _, _, end = shell_scan(text, i + 2, nested=True)
        return end
    if text.startswith("${", i):
        k = i + 2
        while k < n:
            c = text[k]
            if c == "}":
                return k + 1
            if c == "\\":
                k += 2
            elif c == "'":
                k = text.find("'", k + 1) + 1
                if k == 0:
                    raise Fault(i)
            elif c == '"':
                k = _sh_double(text, k)
            elif c == "$":
                k = _sh_dollar(text, k)
            elif c == "`":
                k = _sh_back(text, k)
            else:
                k += 1
        raise Fault(i)
    return i + 1


def shell_scan(text: str, i: int, nested: bool = False) -> tuple[list[str], list[int], int]:
    """Tokens from i to the end, or to the closing parenthesis of a command substitution, whose commands are checked here."""
    out: list[str] = []
    at: list[int] = []
    here: list[tuple[str, bool, int]] = []
    n, depth, patterns = len(text), 0, 0
    reserved = frozenset(SH_RESERVED)
    while i < n:
        c = text[i]
        if c in " \t\r":
            i += 1
            continue
        if c == "\\" and text.startswith(("\\\n", "\\\r\n"), i):
            i += 2 if text[i + 1] == "\n" else 3
            continue
        if c == "#":
            end = text.find("\n", i)
            i = n if end < 0 else end
            continue
        m = SH_OPERATOR.match(text, i)
        if m:
            op = m[0]
            if op == "(":
                depth += 1
            elif op == ")":
                if nested and depth == 0 and not (patterns and out and out[-1] in ("WORD", "NAME")):
                    bad = grammar(".sh").fault([*out, "\n"])
                    if bad >= 0:
                        raise Fault(at[min(bad, len(at) - 1)] if at else i)
                    return out, at, i + 1
                depth = max(0, depth - 1)
            out.append(op)
            at.append(i)
            i = m.end()
            if op in ("<<", "<<-"):
                k = i
                while k < n and text[k] in " \t":
                    k += 1
                w = re.compile(r"'([^'\n]*)'|\"([^\"\n]*)\"|\\?([\w.\-]+)").match(text, k)
                if not w:
                    raise Fault(k)
                here.append((next(x for x in w.groups() if x is not None), op == "<<-", k))
                out.append("WORD")
                at.append(k)
                i = w.end()
            elif op == "\n" and here:
                for tag, tabs, _ in here:
                    while True:
                        if i >= n:
                            break  # a here-document may end with the text
                        end = text.find("\n", i)
                        line = text[i : n if end < 0 else end]
                        i = n if end < 0 else end + 1
                        if (line.lstrip("\t") if tabs else line).rstrip("\r") == tag:
                            break
                here = []
            continue
        begin, plain = i, True
        while i < n:
            c = text[i]
            m = SH_PLAIN.match(text, i)
            if m:
                i = m.end()
            elif c in " \t\r\n&|;<>()":
                break
            elif c == "#":
                i += 1
            elif c == "\\":
                plain = False
                i += 2
            elif c == "'":
                plain = False
                end = text.find("'", i + 1)
                if end < 0:
                    raise Fault(i)
                i = end + 1
            elif c == '"':
                plain = False
                i = _sh_double(text, i)
            elif c == "`":
                plain = False
                i = _sh_back(text, i)
            elif c == "$":
                plain = False
                i = _sh_dollar(text, i)
        word = text[begin:i]
        if plain and word in reserved:
            patterns += (word == "case") - (word == "esac")
            out.append(word)
        elif re.match(r"[A-Za-z_]\w*\+?=", word):
            out.append("SET")
        elif plain and word.isdigit() and i < n and text[i] in "<>":
            out.append("FD")
        else:
            out.append("NAME" if plain and re.fullmatch(r"[A-Za-z_][\w\-.:]*", word) else "WORD")
        at.append(begin)
    if nested:
        raise Fault(i)
    return out, at, i


def shell_tokens(text: str) -> tuple[list[str], list[int]]:
    out, at, _ = shell_scan(text, 0)
    return [*out, "\n"], [*at, len(text)]


SHELL = """
file: nls (line nls)*
nls: NEW*
line: andor ((';' | '&') nls andor)* (';' | '&')? NEW
list: nls andor ((';' | '&' | NEW) nls andor)* (';' | '&')? nls
andor: pipeline (('&&' | '||') nls pipeline)*
pipeline: '!'? command ('|' nls command)*
command: simple | compound redirect* | function
redirect: FD? ('<' | '>' | '>>' | '<&' | '>&' | '<>' | '>|' | '<<' | '<<-') ANY
simple: (SET | redirect)+ (HEAD (ANY | redirect)*)? | HEAD (ANY | redirect)*
function: NAME '(' ')' nls compound redirect*
compound: '{' list '}' | '(' list ')' | 'if' list 'then' list ('elif' list 'then' list)* ('else' list)? 'fi' | ('while' | 'until') list 'do' list 'done'
  | 'for' NAME nls ('in' ANY* (';' | NEW))? ';'? nls 'do' list 'done' | 'case' ANY nls 'in' nls (item nls)* lastitem? 'esac'
item: '('? ANY ('|' ANY)* ')' (list | nls) (';;' | ';&' | ';;&')
lastitem: '('? ANY ('|' ANY)* ')' (list | nls)
"""

# ---------------------------------------------------------------- YAML

YAML_QUOTED = r"\"(?:[^\"\\]|\\(?:\r?\n|.))*\"|'(?:[^']|'')*'"
YAML_PLAIN_FIRST = r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S))"
YAML_KEY = re.compile(rf"(?:(?P<q>{YAML_QUOTED})|(?P<p>(?:[&!][^\s]*[ ]+)*(?:{YAML_PLAIN_FIRST}(?:[^\s:#]|:(?=\S)|(?<=\S)\#|[ \t]+(?![#\s]))*)|<<)|(?P<e>))[ \t]*:(?=[ \t]|\r?$)", re.M)
YAML_FLOW = re.compile(rf"[ \t\r\n]*(?:(?P<p>[\[\]{{}},])|(?P<c>(?<=\s)\#[^\n]*)|(?P<k>:(?=[\s,\[\]{{}}]|\Z))|(?P<q>{YAML_QUOTED}|[&*!][^\s,\[\]{{}}]*)|(?P<w>(?:[^\s,\[\]{{}}:#\"'%@`&*!|>]|:(?![\s,\[\]{{}}]|\Z))(?:[^,\[\]{{}}:#\n]|:(?![\s,\[\]{{}}]|\Z)|(?<=\S)\#)*)|(?P<bad>.|\Z))", re.S)


def yaml_tokens(text: str) -> tuple[list[str], list[int]]:
    """Lines as tokens: IN and OUT for depth, DASH, KEY, VAL, flow collections as their own tokens; a block scalar is one VAL."""
    out: list[str] = []
    at: list[int] = []
    text = text.removeprefix(BOM).replace("\r\n", "\n")
    if m := re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        raise Fault(m.start())
    n, i = len(text), 0
    levels = [-1]

    def put(t: str, p: int) -> None:
        out.append(t)
        at.append(p)

    def close(column: int, p: int) -> None:
        while levels[-1] > column:
            levels.pop()
            put("OUT", p)

    def open_(column: int, p: int) -> None:
        if column > levels[-1]:
            levels.append(column)
            put("IN", p)

    def rest_is_blank(p: int) -> int:
        m = re.compile(r"[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)").match(text, p)
        if not m:
            raise Fault(p)
        return m.end()

    def flow(p: int) -> int:
        depth = 0
        while True:
            m = YAML_FLOW.match(text, p)
            kind = m.lastgroup
            if kind == "bad":
                raise Fault(m.start("bad"))
            p = m.end()
            if kind == "c":
                continue
            token = m[kind]
            put(token if kind == "p" else "F:" if kind == "k" else "FV", m.start(kind))
            if kind == "p":
                depth += (token in "[{") - (token in "]}")
                if depth == 0:
                    return p

    def block_scalar(p: int, parent: int) -> int:
        m = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)").match(text, p)
        if not m:
            raise Fault(p)
        p, deep = m.end(), None
        while p < n:
            end = text.find("\n", p)
            line = text[p : n if end < 0 else end]
            if line.strip(" "):
                lead = len(line) - len(line.lstrip(" "))
                if deep is None:
                    if lead <= parent:
                        break
                    deep = lead
                if lead < deep:
                    if lead > parent and not line.lstrip().startswith("#"):
                        raise Fault(p)
                    if lead <= parent:
                        break
            p = n if end < 0 else end + 1
        return p

    def scalar(p: int, parent: int) -> int:
        """A value that begins at p; deeper lines may carry it on."""
        c = text[p]
        if c in "\"'":
            m = re.compile(YAML_QUOTED).match(text, p)
            if not m:
                raise Fault(p)
            for k in re.finditer("\n", m[0]):  # lines of a quoted scalar are deeper than its parent
                line = text[p + k.end() : text.find("\n", p + k.end()) if text.find("\n", p + k.end()) >= 0 else n]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent and parent >= 0:
                    raise Fault(p + k.end())
            put("VAL", p)
            return rest_is_blank(m.end())
        if c in "[{":
            return rest_is_blank(flow(p))
        if c in "|>":
            put("VAL", p)
            return block_scalar(p, parent)
        if c in "&!*":
            m = re.compile(r"[&!*][^\s]*[ \t]*").match(text, p)
            if c == "*":
                put("VAL", p)
                return rest_is_blank(m.end())
            if m.end() >= n or text[m.end()] in "\n#":
                put("TAG", p)
                return rest_is_blank(m.end())
            return scalar(m.end(), parent)
        if c in "%@`,]}" or not re.compile(YAML_PLAIN_FIRST).match(text, p):
            raise Fault(p)
        begin = p
        while True:
            end = text.find("\n", p)
            end = n if end < 0 else end
            line = text[p:end]
            comment = re.search(r"(?:^|[ \t])#", line)
            body = line[: comment.start()] if comment else line
            if re.search(r":(?:[ \t]|$)", body.rstrip()) :
                raise Fault(p + re.search(r":(?:[ \t]|$)", body.rstrip()).start())
            p = min(n, end + 1)
            if comment:
                break
            k = p
            while k < n and text[k] == "\n":
                k += 1
            m = re.compile(r"( *)(\t*)(\S)").match(text, k)
            if not m or len(m[1]) <= parent or m[3] == "#" or text.startswith(("---", "..."), k):
                break
            p = k + len(m[1]) + len(m[2])
        put("VAL", begin)
        return p

    while i < n:
        m = re.compile(r"( *)([^\n]*)(?:\n|\Z)").match(text, i)
        body = m[2]
        if not body.strip() or body.lstrip().startswith("#"):
            i = max(m.end(), i + 1)
            continue
        column = len(m[1])
        if body[0] == "\t":
            raise Fault(i + column)
        if column == 0 and re.match(r"(?:---|\.\.\.)(?:[ \t]|$)", body):
            close(-1, i)
            put("DOC" if body[0] == "-" else "STOP", i)
            left = body[3:].strip()
            if left and not left.startswith("#"):
                i = scalar(i + 3 + len(body[3:]) - len(body[3:].lstrip()), -1)
            else:
                i = m.end()
            continue
        if column == 0 and body.startswith("%"):
            i = m.end()
            continue
        p = i + column
        close(column, p)
        open_(column, p)
        if levels[-1] != column:
            raise Fault(p)
        while True:
            if re.compile(r"-(?:[ \t]|\n|\Z)").match(text, p):
                put("DASH", p)
                gap = re.compile(r"-[ \t]*").match(text, p)
                p = gap.end()
                if p >= n or text[p] in "\n" or (text[p] == "#" and gap[0][-1] in " \t"):
                    i = rest_is_blank(p) if p < n and text[p] == "#" else min(n, p + 1)
                    break
                column = p - (text.rfind("\n", 0, p) + 1)
                again = re.compile(r"-(?:[ \t]|\n|\Z)").match(text, p)
                key = YAML_KEY.match(text, p)
                if not again and not key:
                    i = scalar(p, levels[-1])
                    break
                open_(column, p)
                continue
            key = YAML_KEY.match(text, p) if text[p] not in "[{|>" else None
            if text.startswith("? ", p):
                put("KEY", p)
                i = scalar(p + 2, levels[-1])
                break
            if not key or (key.lastgroup == "q" and "\n" in key[0]):
                i = scalar(p, levels[-1] - 1 if levels[-1] > 0 else -1)
                break
            put("KEY", p)
            p = key.end()
            gap = re.compile(r"[ \t]*").match(text, p)
            p = gap.end()
            if p >= n or text[p] == "\n" or (text[p] == "#" and gap[0]):
                i = rest_is_blank(p) if p < n and text[p] == "#" else min(n, p + 1)
                break
            if re.compile(r"-[ \t]").match(text, p):
                raise Fault(p)
            i = scalar(p, levels[-1])
            break
    close(-1, n)
    return out, at


YAML = """
stream: document? ((DOC | STOP) document?)*
document: IN node OUT | flow | VAL | TAG (IN node OUT)?
node: mapping | sequence | VAL | flow
mapping: (KEY value)+
value: VAL | flow | TAG? nested?
nested: IN node OUT | sequence
sequence: (DASH item)+
item: VAL | flow | TAG? (IN node OUT)?
flow: '[' (flowitem (',' flowitem)* ','?)? ']' | '{' (flowpair (',' flowpair)* ','?)? '}'
flowitem: flownode ('F:' flownode?)? | 'F:' flownode?
flowpair: flownode ('F:' flownode?)? | 'F:' flownode?
flownode: flow | FV+ flow?
"""

TOKENS = {
    ".json": json_tokens,
    ".py": python_tokens,
    ".js": lambda t: script_tokens(t, True, frozenset(JS_KEYWORDS), frozenset(JS_CONTEXT)),
    ".ts": lambda t: script_tokens(t, True, frozenset(JS_KEYWORDS), frozenset(TS_CONTEXT)),
    ".go": go_tokens,
    ".java": java_tokens,
    ".sh": shell_tokens,
    ".yaml": yaml_tokens,
}


@lru_cache(16)
def grammar(suffix: str) -> Grammar:
    """The grammar of a suffix, with its memo, for the life of the process."""
    both = lambda words: {w: (w, "ID") for w in words}
    if suffix == ".json":
        return Grammar(JSON, "value")
    if suffix == ".py":
        soft = {w: (w, "ID") for w in ("match", "case", "type", "_")}
        return Grammar(
            PYTHON.replace("NAME", "ID"), "file", soft,
            {"BIN": _words("+ - * / // % @ ** << >> & | ^ < > <= >= == != and or in is"), "PRE": _words("+ - ~ not await"), "AUG": _words("+= -= *= /= //= %= @= **= <<= >>= &= |= ^=")},
        )
    if suffix in (".js", ".ts"):
        context = JS_CONTEXT if suffix == ".js" else TS_CONTEXT
        classes = {"BIN": JS_BIN, "AUG": JS_AUG, "PRE": JS_PRE, "NAME": (*JS_KEYWORDS, *context, "ID"), "MODIFIER": TS_MODIFIER}
        return Grammar(SCRIPT if suffix == ".js" else TYPED, "program", both(context), classes)
    if suffix == ".go":
        return Grammar(
            GO, "file", {},
            {"BIN": _words("+ - * / % & | ^ << >> &^ == != < <= > >= && ||"), "PRE": _words("+ - ! ^ * & <-"), "AUG": _words("+= -= *= /= %= &= |= ^= <<= >>= &^=")},
        )
    if suffix == ".java":
        return Grammar(
            JAVA, "file", both(JAVA_CONTEXT),
            {
                "BIN": _words("+ - * / % & | ^ << == != < <= && ||"), "PRE": _words("+ - ! ~ ++ --"), "AUG": _words("+= -= *= /= %= &= |= ^= <<="),
                "PRIMITIVE": _words("boolean byte char double float int long short"),
                "MODIFIER": _words("public protected private static final abstract synchronized native default strictfp transient volatile sealed"),
            },
        )
    if suffix == ".sh":
        any_word = ("WORD", "NAME", "SET", "FD", *SH_RESERVED)
        return Grammar(SHELL, "file", {}, {"NEW": ("\n",), "ANY": any_word, "HEAD": ("WORD", "NAME")})
    if suffix == ".yaml":
        return Grammar(YAML, "stream")
    raise KeyError(suffix)


def check(text: str, suffix: str) -> tuple[str, int] | None:
    """None for valid text, else what is wrong (unexpected, truncated) and the offset where it shows."""
    try:
        tokens, at = TOKENS[suffix](text)
    except Fault as f:
        return "unexpected", int(f.args[0])
    except RecursionError:
        return "unexpected", 0
    bad = grammar(suffix).fault(tokens)
    if bad < 0:
        return None
    return ("truncated", len(text)) if bad >= len(tokens) else ("unexpected", at[bad])
