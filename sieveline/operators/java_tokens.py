"""One text of a Java-like language cut into tokens and read once, left to right, with stacks for brackets, blocks and open methods.

Nested brackets are no regular language, so column expressions can follow them only to a fixed depth. This is the small helper that
runs inside an Arrow function instead: time and memory grow with the text, whatever its nesting and however many methods it has.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d\w*|->|::|&&|\|\||[^\s\w\x01\x02]", re.ASCII)
_STARTS_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp".split())
_NO_TYPE = _MODIFIERS | frozenset(
    "return new else throw case assert package import goto instanceof yield do class interface enum record extends implements throws".split())
_NO_NAME = frozenset("if for while switch catch synchronized super this try return new".split())
_WITH_CONDITION = frozenset("if for while switch catch synchronized try".split())
_DECIDING = frozenset("? && || for if while catch case default".split())
_NOT_IN_TYPES = frozenset("(){};=")


def _pairs(tokens: list[str]) -> list[int]:
    """For each round bracket its counterpart, for other tokens and lone brackets -1."""
    out, waiting = [-1] * len(tokens), []
    for i, t in enumerate(tokens):
        if t == "(":
            waiting.append(i)
        elif t == ")" and waiting:
            o = waiting.pop()
            out[o], out[i] = i, o
    return out


def _back_over_angles(tokens: list[str], i: int) -> int:
    """The place before the ``<`` that belongs to the ``>`` at i, or -2 if there is none."""
    depth = 0
    while i >= 0 and tokens[i] not in _NOT_IN_TYPES:
        depth += (tokens[i] == ">") - (tokens[i] == "<")
        if not depth:
            return i - 1
        i -= 1
    return -2


def _back_over_name(tokens: list[str], i: int) -> int:
    """The first token of a name with dots that ends at i."""
    while i > 1 and tokens[i - 1] == "." and tokens[i - 2][0] in _STARTS_WORD:
        i -= 2
    return i


def _header_start(tokens: list[str], pairs: list[int], name: int) -> int:
    """The first token of a method header with its name at ``name``, or -1: before the name stands a type, and before that type
    parameters, modifiers and annotations."""
    i = name - 1
    while i > 0 and tokens[i] == "]" and tokens[i - 1] == "[":
        i -= 2
    if i >= 0 and tokens[i] == ">":
        i = _back_over_angles(tokens, i)
    if i < 0 or tokens[i][0] not in _STARTS_WORD:
        return -1
    start = _back_over_name(tokens, i)
    if tokens[start] in _NO_TYPE or (start and tokens[start - 1] in (".", "@")):
        return -1
    if start and tokens[start - 1] == ">":
        before = _back_over_angles(tokens, start - 1)
        start = before + 1 if before > -2 else start
    while start:
        i = start - 1
        if tokens[i] in _MODIFIERS:
            start = i
            continue
        if tokens[i] == ")" and pairs[i] > 0:
            i = pairs[i] - 1
        at = _back_over_name(tokens, i) - 1 if tokens[i][0] in _STARTS_WORD else -1
        if at < 0 or tokens[at] != "@":
            break
        start = at
    return start


def _header_stop(tokens: list[str], pairs: list[int], name: int) -> int:
    """The ``{`` or ``;`` that ends a header with its name at ``name``, or -1."""
    shut, i = pairs[name + 1], name + 2
    while i < shut:
        if tokens[i] in "{};":
            return -1
        i = (pairs[i] if tokens[i] == "(" else i) + 1
    i, n = shut + 1, len(tokens)
    while i + 1 < n and tokens[i] == "[" and tokens[i + 1] == "]":
        i += 2
    if i < n and tokens[i] == "throws":
        i += 1
        while i < n and (tokens[i] in ".," or tokens[i][0] in _STARTS_WORD):
            i += 1
    return i if i < n and tokens[i] in "{;" else -1


def _parameters(tokens: list[str], first: int, end: int) -> int:
    """Commas outside all brackets, plus one. Angle brackets count outside the other ones only, where they compare nothing."""
    inner = angle = commas = 0
    for t in tokens[first:end]:
        if t in "({[":
            inner += 1
        elif t in ")}]":
            inner -= 1
        elif not inner:
            angle += (t == "<") - (t == ">")
            commas += t == "," and not angle
    return commas + 1 if end > first else 0


def _is_classic(tokens: list[str], pairs: list[int], word: int) -> bool:
    """Whether the head of the ``for`` at ``word`` has a semicolon of its own."""
    if word + 1 >= len(tokens) or tokens[word + 1] != "(" or pairs[word + 1] < 0:
        return False
    i, end = word + 2, pairs[word + 1]
    while i < end:
        if tokens[i] == ";":
            return True
        i = (pairs[i] if tokens[i] == "(" else i) + 1
    return False


class _Reader:
    def __init__(self, text: str, boolean_ops: bool):
        self.tokens, self.lines, self.boolean_ops = [], [], boolean_ops
        for number, line in enumerate(text.split("\n"), 1):
            found = _TOKEN.findall(line)
            self.tokens += found
            self.lines += [number] * len(found)
        self.pairs = _pairs(self.tokens)

    def decides(self, i: int) -> int:
        """What token i adds to the complexity of the method it stands in."""
        tokens, t = self.tokens, self.tokens[i]
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t == "?":
            bound = after == "extends" or (after == "super" and i + 2 < len(tokens) and tokens[i + 2][0].isalpha())
            return int(not bound and after not in (">", ",", "&"))
        if t in ("&&", "||"):
            return int(self.boolean_ops)
        if t == "for":
            return int(_is_classic(tokens, self.pairs, i))
        return int(t in ("if", "while", "catch", "case") or (t == "default" and after in ("->", ":")))

    def facts(self) -> list[tuple]:
        tokens, lines, pairs, n = self.tokens, self.lines, self.pairs, len(self.tokens)
        found, stack, methods = [], [], []  # methods: name, line, parameters, depth, base, complexity, nesting
        level = pending = chain = i = 0
        while i < n:
            t = tokens[i]
            after = tokens[i + 1] if i + 1 < n else ""
            if after == "(" and t not in _NO_NAME and t[0] in _STARTS_WORD and pairs[i + 1] > 0:
                start, stop = _header_start(tokens, pairs, i), _header_stop(tokens, pairs, i)
                if start >= 0 and stop >= 0:
                    parameters = _parameters(tokens, i + 2, pairs[i + 1])
                    if tokens[stop] == ";":
                        found.append((t, lines[start], lines[stop], parameters, 1, 0))
                    else:
                        methods.append([t, lines[start], parameters, len(stack) + 1, level, 1, level])
                        stack.append((level, chain))
                        level, pending, chain = level + pending, 0, 0
                    i = stop + 1
                    continue
            if t == "{":
                stack.append((level, chain))
                level, pending, chain = level + pending, 0, 0
            elif t == "}":
                pending = 0
                if stack:
                    if methods and methods[-1][3] == len(stack):
                        name, line, parameters, _, base, complexity, nesting = methods.pop()
                        found.append((name, line, lines[i], parameters, complexity, nesting - base))
                        if methods:
                            methods[-1][5] += complexity - 1
                            methods[-1][6] = max(methods[-1][6], nesting)
                    level, chain = stack.pop()
            elif t == ";":
                pending = 0
            elif t in _WITH_CONDITION and (after == "(" or t != "synchronized") or t in ("else", "do", "finally"):
                i, level, pending, chain = self._control(i, stack, methods, level, pending, chain)
                continue
            elif methods and t in _DECIDING:
                methods[-1][5] += self.decides(i)
            i += 1
        return found

    def _control(self, i: int, stack: list, methods: list, level: int, pending: int, chain: int):
        """A control with its condition, in which code counts for complexity only. Each else-if nests one deeper than the one before."""
        tokens, pairs, n = self.tokens, self.pairs, len(self.tokens)
        word, decisions, adds = tokens[i], self.decides(i), 1
        if word == "else":
            adds += chain
            if i + 1 < n and tokens[i + 1] == "if":
                i, chain, word = i + 1, chain + 1, "if"
                adds, decisions = 1 + chain, self.decides(i)
        elif word == "if":
            chain = 0
        elif word == "synchronized":
            adds = 0
        elif word == "for":
            adds = decisions
        end = i
        if word in _WITH_CONDITION and i + 1 < n and tokens[i + 1] == "(" and pairs[i + 1] > 0:
            end = pairs[i + 1]
            decisions += sum(map(self.decides, range(i + 2, end)))
        reached = level + pending + adds
        if methods:
            methods[-1][5] += decisions
            methods[-1][6] = max(methods[-1][6], reached)
        if end + 1 < n and tokens[end + 1] == "{":
            stack.append((level, chain))
            return end + 2, reached, 0, 0
        return end + 1, level, pending + adds, chain


def method_facts_of(text: str, boolean_ops: bool = False) -> list[tuple]:
    """(name, start line, end line, parameters, complexity, nesting) of the methods of a masked text, in the order in which they end."""
    return _Reader(text, boolean_ops).facts()
