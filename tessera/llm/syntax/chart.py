"""A parser driven by grammar texts, with a chart shared by all files of a worker.

A token stream is first folded at its brackets: the content of each group is a
tuple of token codes in which inner groups are already one code, and equal
contents get one number (their shape).  Whether a shape is derived by a rule in
a context is an entry of the chart, computed once and kept; since identifiers and
literals are one code each, most groups of a file were met before.  Rules are
ordered choices read from a grammar text:

    name = alternative / alternative ;      'kw' terminal    x? x* x+ !x &x ( )
    P<rule> B<rule> S<rule>   a ( ), { } or [ ] group whose whole content is rule
    T<rule> L<rule> I<rule>   the same of a template or its parts, of a logical line, of an indented block
    rule:abc, P<rule:abc>     with flags set (capital) or cleared (small)
    %A                        only with flag A
    nl  a line break or the end comes next      end  the end      tok  any token
"""

from __future__ import annotations

import re
import sys

#: Rules are plain functions, whose frames lie on the heap, so depth costs memory only.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

_PIECE = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|'(?P<lit>[^']+)'|%(?P<flag>[A-Z])|(?P<op>[/?*+!&()<>:;=]))")
_OPENS, _CLOSES = {"(": ")", "{": "}", "[": "]"}, {")": "(", "}": "{", "]": "["}
_KINDS = {"P": "(", "B": "{", "S": "[", "T": "`", "L": "L", "I": "I"}
#: Entries kept before a chart is emptied; bounds a worker's memory, not what is parsed.
MOST_SHAPES = 400_000


class Grammar:
    """Rules compiled to functions (codes, at, flags) -> end or -1."""

    def __init__(self, text: str, flags: str, classes: tuple[str, ...]):
        self.flag = {f: 1 << i for i, f in enumerate(flags)}
        self.code: dict[str, int] = {}
        for c in (*"([{)]}", *classes):  # brackets have the least codes
            self.code_of(c)
        self.rules: dict[str, object] = {}
        self.sources = {}
        for line in re.split(r";\s*\n", re.sub(r"(?m)^\s*--.*$", "", text)):
            if line.strip():
                name, _, body = line.partition("=")
                self.sources[name.strip()] = body
        for name, body in self.sources.items():
            self.rules[name] = self._compile(body)
        self.reset()

    def code_of(self, kind: str) -> int:
        """Codes are even; the low bit says that a line break came before."""
        return self.code.setdefault(kind, 2 * len(self.code))

    def reset(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.contents: list[tuple[str, tuple]] = []
        self.chart: dict[tuple, bool] = {}
        self.base = 1 << 20

    def shape(self, kind: str, content: list[int]) -> int:
        key = (kind, tuple(content))
        n = self.shapes.get(key)
        if n is None:
            n = self.shapes[key] = self.base + 2 * len(self.contents)
            self.contents.append(key)
        return n

    def derives(self, rule: str, flags: int, content: tuple) -> bool:
        return self.rules[rule](content, 0, flags) == len(content)

    # the grammar text's own parser
    def _compile(self, body: str):
        pieces = [m for m in _PIECE.finditer(body)]
        at = 0

        def peek(op: str) -> bool:
            return at < len(pieces) and pieces[at]["op"] == op

        def flags_after() -> tuple[int, int]:
            nonlocal at
            on = off = 0
            if peek(":"):
                at += 1
                for ch in pieces[at]["name"]:
                    if ch.isupper():
                        on |= self.flag[ch]
                    else:
                        off |= self.flag[ch.upper()]
                at += 1
            return on, off

        def choice():
            nonlocal at
            alts = [sequence()]
            while peek("/"):
                at += 1
                alts.append(sequence())
            if len(alts) == 1:
                return alts[0]

            def run(t, i, f):
                for alt in alts:
                    j = alt(t, i, f)
                    if j >= 0:
                        return j
                return -1

            return run

        def sequence():
            nonlocal at
            items = []
            while at < len(pieces) and pieces[at]["op"] not in ("/", ")", ";"):
                items.append(prefixed())
            if len(items) == 1:
                return items[0]

            def run(t, i, f):
                for item in items:
                    i = item(t, i, f)
                    if i < 0:
                        return -1
                return i

            return run

        def prefixed():
            nonlocal at
            for op in ("!", "&"):
                if peek(op):
                    at += 1
                    x = prefixed()
                    if op == "!":
                        return lambda t, i, f: i if x(t, i, f) < 0 else -1
                    return lambda t, i, f: i if x(t, i, f) >= 0 else -1
            return suffixed()

        def suffixed():
            nonlocal at
            x = atom()
            while at < len(pieces) and pieces[at]["op"] in ("?", "*", "+"):
                op = pieces[at]["op"]
                at += 1
                x = self._repeat(x, op)
            return x

        def atom():
            nonlocal at
            m = pieces[at]
            at += 1
            if m["op"] == "(":
                x = choice()
                at += 1
                return x
            if m["flag"]:
                bit = self.flag[m["flag"]]
                return lambda t, i, f: i if f & bit else -1
            if m["lit"]:
                code = self.code_of(m["lit"])
                return lambda t, i, f: i + 1 if i < len(t) and t[i] & -2 == code else -1
            name = m["name"]
            if name == "nl":
                return lambda t, i, f: i if i >= len(t) or t[i] & 1 else -1
            if name == "tok":
                return lambda t, i, f: i + 1 if i < len(t) else -1
            if name == "end":
                return lambda t, i, f: i if i >= len(t) else -1
            if name in _KINDS and peek("<"):
                at += 1
                rule = pieces[at]["name"]
                at += 1
                on, off = flags_after()
                at += 1
                return self._group(_KINDS[name], rule, on, off)
            if name.isupper() and name not in self.sources:  # a token class
                code = self.code_of(name)
                return lambda t, i, f: i + 1 if i < len(t) and t[i] & -2 == code else -1
            on, off = flags_after()
            rules = self.rules
            if not on and not off:
                return lambda t, i, f: rules[name](t, i, f)
            return lambda t, i, f: rules[name](t, i, f & ~off | on)

        return choice()

    @staticmethod
    def _repeat(x, op: str):
        if op == "?":

            def run(t, i, f):
                j = x(t, i, f)
                return i if j < 0 else j

            return run

        def many(t, i, f):
            if op == "+":
                i = x(t, i, f)
                if i < 0:
                    return -1
            while True:
                j = x(t, i, f)
                if j <= i:
                    return i
                i = j

        return many

    def _group(self, kind: str, rule: str, on: int, off: int):
        base = self.base = 1 << 20

        def run(t, i, f):
            if i >= len(t) or t[i] < base:
                return -1
            n = (t[i] - base) >> 1
            k, content = self.contents[n]
            if k != kind:
                return -1
            f = f & ~off | on
            key = (n, rule, f)
            ok = self.chart.get(key)
            if ok is None:
                ok = self.chart[key] = self.derives(rule, f, content)
            return i + 1 if ok else -1

        return run

    def fold(self, codes: list[tuple[int, str]] | list, opens: dict[int, str], closes: dict[int, str]) -> tuple | None:
        """Codes with brackets to nested shapes; None if brackets don't match."""
        stack: list[tuple[str, int, list[int]]] = []
        cur: list[int] = []
        for c in codes:
            k = c & -2
            if k in opens:
                stack.append((opens[k], c & 1, cur))
                cur = []
            elif k in closes:
                if not stack or stack[-1][0] != closes[k]:
                    return None
                kind, nl, outer = stack.pop()
                outer.append(self.shape(kind, cur) | nl)
                cur = outer
            else:
                cur.append(c)
        return None if stack else tuple(cur)

    def by_shape(self) -> dict[int, list[tuple[str, int, bool]]]:
        """(rule, flags, derived) of every entry of the chart, by shape."""
        out: dict[int, list[tuple[str, int, bool]]] = {}
        for (n, rule, f), ok in self.chart.items():
            out.setdefault(n, []).append((rule, f, ok))
        return out
