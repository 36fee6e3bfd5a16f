"""Parsing with memoised partial derivatives of context-free expressions.

A grammar is a set of named expressions over tokens. What may still come is a set of continuations, each a list of
expressions to be matched one after another; continuations and sets are made once and shared, so that the derivative of a
set by a token is computed once and then looked up. An empty set marks the token at fault; a set without a nullable
continuation at the end means that the text breaks off.
"""

from __future__ import annotations

import re

EPS = ("eps",)


class Grammar:
    """Built from rules "name: alternatives"; tokens are 'quoted' or in CAPITALS, rules in small letters; operators | * + ? ()."""

    def __init__(self, rules: str, start: str, aliases: dict[str, tuple[str, ...]] | None = None, classes: dict[str, tuple[str, ...]] | None = None):
        self.classes = {k: frozenset(v) for k, v in (classes or {}).items()}
        self.aliases = aliases or {}
        self.nodes: dict[tuple, int] = {}
        self.expr: list[tuple] = []
        self.rules: dict[str, int] = {}
        self.nullable_memo: dict[int, bool] = {}
        self.conts: dict[tuple[int, int], int] = {}  # (expression, rest) -> continuation; 0 is the empty one
        self.cont: list[tuple[int, int]] = [(-1, -1)]
        self.cont_steps: list[dict[str, frozenset[int]]] = [{}]
        self.states: dict[frozenset[int], dict] = {}
        self.eps = self._node(EPS)
        for name, body in re.findall(r"(?ms)^(\w+):(.*?)(?=^\w+:|\Z)", rules):
            self.rules[name] = self._parse(body)
        missing = {e[1] for e in self.expr if e[0] == "ref"} - self.rules.keys()
        if missing:
            raise ValueError(f"rules without a body: {missing}")
        self.start_expr = self.rules[start]
        self.reset()

    def reset(self) -> None:
        self.conts, self.cont, self.cont_steps, self.states = {}, [(-1, -1)], [{}], {}
        self.first = self._state(frozenset((self._push(self.start_expr, 0),)))

    def _node(self, e: tuple) -> int:
        if e not in self.nodes:
            self.nodes[e] = len(self.expr)
            self.expr.append(e)
        return self.nodes[e]

    def _parse(self, body: str) -> int:
        parts = re.findall(r"'[^']+'|\w+|[|*+?()]", body)
        at = 0

        def alternatives() -> int:
            nonlocal at
            found = [sequence()]
            while at < len(parts) and parts[at] == "|":
                at += 1
                found.append(sequence())
            return found[0] if len(found) == 1 else self._node(("alt", *found))

        def sequence() -> int:
            nonlocal at
            found = []
            while at < len(parts) and parts[at] not in ("|", ")"):
                p = parts[at]
                at += 1
                if p == "(":
                    e = alternatives()
                    at += 1
                elif p[0] == "'":
                    e = self._node(("tok", frozenset((p[1:-1],))))
                elif p[0].isupper():
                    e = self._node(("tok", self.classes.get(p, frozenset((p,)))))
                else:
                    e = self._node(("ref", p))
                while at < len(parts) and parts[at] in "*+?":
                    op = parts[at]
                    at += 1
                    if op == "?":
                        e = self._node(("alt", e, self.eps))
                    elif op == "*":
                        e = self._node(("star", e))
                    else:
                        e = self._node(("seq", e, self._node(("star", e))))
                found.append(e)
            out = self.eps
            for e in reversed(found):
                out = e if out == self.eps else self._node(("seq", e, out))
            return out

        return alternatives()

    def _nullable(self, e: int) -> bool:
        known = self.nullable_memo.get(e)
        if known is None:
            self.nullable_memo[e] = False  # least fixed point; grammars here have no nullable recursion
            kind, *of = self.expr[e]
            known = self.nullable_memo[e] = (
                kind in ("eps", "star")
                or (kind == "alt" and any(self._nullable(x) for x in of))
                or (kind == "seq" and all(self._nullable(x) for x in of))
                or (kind == "ref" and self._nullable(self.rules[of[0]]))
            )
        return known

    def _push(self, e: int, rest: int) -> int:
        if e == self.eps:
            return rest
        key = (e, rest)
        k = self.conts.get(key)
        if k is None:
            k = self.conts[key] = len(self.cont)
            self.cont.append(key)
            self.cont_steps.append({})
        return k

    def _partial(self, e: int, token: str, rest: int, out: set[int]) -> None:
        kind, *of = self.expr[e]
        if kind == "tok":
            if token in of[0]:
                out.add(rest)
        elif kind == "alt":
            for x in of:
                self._partial(x, token, rest, out)
        elif kind == "seq":
            self._partial(of[0], token, self._push(of[1], rest), out)
            if self._nullable(of[0]):
                self._partial(of[1], token, rest, out)
        elif kind == "star":
            self._partial(of[0], token, self._push(e, rest), out)
        elif kind == "ref":
            self._partial(self.rules[of[0]], token, rest, out)

    def _step(self, k: int, token: str) -> frozenset[int]:
        known = self.cont_steps[k].get(token)
        if known is None:
            out: set[int] = set()
            at = k
            while at:
                e, rest = self.cont[at]
                self._partial(e, token, rest, out)
                if not self._nullable(e):
                    break
                at = rest
            known = self.cont_steps[k][token] = frozenset(out)
        return known

    def _state(self, conts: frozenset[int]) -> dict:
        s = self.states.get(conts)
        if s is None:
            s = self.states[conts] = {"": conts}
        return s

    def derive(self, state: dict, token: str) -> dict | None:
        """The state behind a token, None if there is none. OPTIONAL tokens may also be passed over."""
        found: set[int] = set()
        name = token[1:] if token[0] == "\0" else token
        for t in self.aliases.get(name, (name,)):
            for k in state[""]:
                found |= self._step(k, t)
        if token[0] == "\0":
            found |= state[""]
        state[token] = out = self._state(frozenset(found)) if found else None
        return out

    def ends(self, state: dict) -> bool:
        for k in state[""]:
            while k and self._nullable(self.cont[k][0]):
                k = self.cont[k][1]
            if not k:
                return True
        return False

    def fault(self, tokens: list[str]) -> int:
        """-1 if the tokens are a sentence, else the index of the first token at fault; their number if they break off."""
        if len(self.cont) > 300_000 or len(self.states) > 200_000:
            self.reset()
        state = self.first
        for i, t in enumerate(tokens):
            try:
                state = state[t]
            except KeyError:
                state = self.derive(state, t)
            if state is None:
                return i
        return -1 if self.ends(state) else len(tokens)
