"""Token streams of the bundled languages.

One pattern a language; what it can't match is a BAD token, which no rule takes.
"""

from __future__ import annotations

import re

from tessera.llm.syntax import grammars
from tessera.llm.syntax.chart import MOST_SHAPES, Grammar

_OPENS, _CLOSES = {"(": "(", "{": "{", "[": "["}, {")": "(", "}": "{", "]": "["}
_SKIP, _LINE, _PARTS = -2, -4, -6
_MEMO = 200_000

_WORD = r"[^\W\d]\w*"
_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"

_PROTO = re.compile(
    rf"""\s*([A-Za-z_]\w*+|{_COMMENTS}|"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'|0[xX][0-9a-fA-F]+\b|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\w*|[^\s])"""
)
_GO_ESC = r"\\(?:[abfnrtv\\{q}]|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}})"
_GO = re.compile(
    rf"""[ \t\r]*({_WORD}|\n|{_COMMENTS}|"(?:[^"\\\n]|{_GO_ESC.format(q='"')})*"|`[^`]*`|'(?:[^'\\\n]|{_GO_ESC.format(q="'")})'"""
    r"""|0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+i?|0[xX][0-9a-fA-F_]+i?\b|0[bB][01_]+\b|0[oO][0-7_]+\b|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?\w*"""
    r"""|\.\.\.|<<=|>>=|&\^=|:=|\+\+|--|&&|\|\||==|!=|<=|>=|<-|<<|>>|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[^\s])"""
)
_BEFORE_RE = "".join((r"=(,:\[!&|?{;+\-*%<>~^", r"\n"))
_HOLE2 = r"\{(?:[^{}`]|\{[^{}`]*\})*\}"
_HOLE = rf"(?:[^{{}}`]|{_HOLE2}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{[^{{}}`]*\}})*`)*"
_SCRIPT = re.compile(
    rf"""[ \t\r]*([A-Za-z_$][\w$]*+|\n|{_COMMENTS}|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_HOLE}\}})*`"""
    rf"""|(?:(?<=[{_BEFORE_RE}])|(?<=[{_BEFORE_RE}]\s)|(?<=return\s)|(?<=typeof\s)|(?<=case\s)|(?<=\s\s))"""
    r"""/(?![*/\s])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"""
    r"""|\#?(?:[^\W\d]|\$)(?:\w|\$)*"""
    r"""|0[xX][0-9a-fA-F_]+n?\b|0[bB][01_]+n?\b|0[oO][0-7_]+n?\b|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?[\w$]*"""
    r"""|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|<<|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[^\s])"""
)
_HOLES = re.compile(rf"\\[\s\S]|\$\{{({_HOLE})\}}")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+i?|0[xX][0-9a-fA-F_]+[ni]?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[ni]?")


class Language:
    """A token pattern, its grammar and the chart of this worker."""

    start_flags = 0
    #: Code of tokens that a lexer puts in without text; they are not counted as places.
    inserted: frozenset[int] = frozenset()

    def __init__(self, pattern: re.Pattern, text: str, words: list[str], flags: str, classes: tuple[str, ...] = ()):
        self.pattern = pattern
        self.grammar = Grammar(text, flags, ("ID", "NUM", "STR", "CHAR", "RE", "TMPL", "PRIV", "BAD", *classes))
        g = self.grammar
        self.words = {w: g.code_of(w) for w in words}
        self.opens = {g.code_of(k): v for k, v in _OPENS.items()}
        self.closes = {g.code_of(k): v for k, v in _CLOSES.items()}
        self.c = {k: g.code_of(k) for k in ("ID", "NUM", "STR", "CHAR", "RE", "TMPL", "PRIV", "BAD")}
        self.memo: dict[str, int] = {}

    def classify(self, tok: str) -> int:
        ch = tok[0]
        if tok == "\n":
            return _LINE
        if tok in self.words:
            return self.words[tok]
        if ch.isalpha() or ch in "_$":
            return self.c["ID"]
        if ch == "#":
            return self.c["PRIV"] if len(tok) > 1 else self.c["BAD"]
        if ch.isdigit() or (ch == "." and len(tok) > 1 and tok[1].isdigit()):
            return self.c["NUM"] if _NUMBER.fullmatch(tok) else self.c["BAD"]
        if ch in "\"'":
            return self.quoted(tok)
        if ch == "`":
            return self.c["BAD"] if len(tok) < 2 else self.raw(tok)
        if ch == "/" and len(tok) > 1:
            if tok[1] == "/" or tok[1] == "*" and len(tok) > 2:
                return _LINE if "\n" in tok else _SKIP
            if tok not in ("/=",):
                return self.c["RE"]
        code = self.grammar.code.get(tok)
        return self.c["BAD"] if code is None else code

    def quoted(self, tok: str) -> int:
        return self.c["STR"] if len(tok) > 1 else self.c["BAD"]

    def raw(self, tok: str) -> int:
        return self.c["STR"]

    def codes(self, text: str) -> list[int]:
        memo, out, nl = self.memo, [], 0
        if len(memo) > _MEMO:
            memo.clear()
        get, add = memo.get, out.append
        for tok in self.pattern.findall(text):
            c = get(tok)
            if c is None:
                c = memo[tok] = self.classify(tok)
            if c >= 0:
                add(c | nl)
                nl = 0
            elif c == _LINE:
                nl = 1
            elif c == _PARTS:
                add(self.parts(tok) | nl)
                nl = 0
        return out

    def parts(self, tok: str) -> int:
        raise NotImplementedError

    def folded(self, text: str) -> tuple | None:
        return self.grammar.fold(self.codes(text), self.opens, self.closes)

    def valid(self, text: str) -> bool:
        content = self.folded(text)
        if content is not None and len(self.grammar.contents) > MOST_SHAPES:  # the chart is full: one of its own for this file
            self.grammar.reset()
            content = self.folded(text)
        return content is not None and self.grammar.derives("file", self.start_flags, content)

    def first_error(self, text: str) -> tuple[int, str]:
        """(line, reason) of an invalid text: a token, a bracket, or where no rule goes on.

        Reasons are token, bracket and grammar.  In the last case the group in
        which parsing stopped is entered as long as every rule tried on it failed.
        """
        line = lambda at: text.count("\n", 0, at) + 1
        stack: list[tuple[str, int, list]] = []
        cur: list[tuple[int, list | None]] = []  # (place, inner tokens) of what folded() sees, less inserted semicolons
        for m in self.pattern.finditer(text):
            c = self.classify(m[1])
            if c == self.c["BAD"]:
                return line(m.start(1)), "token"
            if c in self.closes:
                if not stack or stack[-1][0] != self.closes[c]:
                    return line(m.start(1)), "bracket"
                _, at, outer = stack.pop()
                outer.append((at, cur))
                cur = outer
            elif c in self.opens:
                stack.append((self.opens[c], m.start(1), cur))
                cur = []
            elif c >= 0 or c == _PARTS:
                cur.append((m.start(1), None))
        if stack:
            return line(stack[-1][1]), "bracket"
        content = self.folded(text) or ()
        place, tried, known = 0, [("file", self.start_flags)], self.grammar.by_shape()
        while cur:
            stop = max(max(0, self.grammar.rules[r](content, 0, f)) for r, f in tried)
            # inserted semicolons have no place of their own
            real = [i for i, c in enumerate(content) if c & -2 not in self.inserted]
            k = sum(1 for i in real if i < stop)
            place = cur[min(k, len(cur) - 1)][0]
            for (at, inner), i in list(zip(cur, real))[k:]:
                n = (content[i] - self.grammar.base) >> 1
                tried = [x[:2] for x in known.get(n, ())]
                if inner and tried and not any(x[2] for x in known[n]):
                    content, cur = self.grammar.contents[n][1], inner
                    break
            else:
                break
        return line(place), "grammar"


class Go(Language):
    def __init__(self):
        super().__init__(_GO, grammars.GO, grammars.GO_WORDS, "C")
        self.start_flags = self.grammar.flag["C"]
        code = self.grammar.code_of
        self.semi = code(";")
        self.inserted = frozenset((self.semi,))
        self.ends = {self.c[k] for k in ("ID", "NUM", "STR", "CHAR")} | {code(k) for k in ("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}

    def quoted(self, tok: str) -> int:
        return self.c["BAD"] if len(tok) < 2 else self.c["STR" if tok[0] == '"' else "CHAR"]

    def codes(self, text: str) -> list[int]:
        out, ends, semi = [], self.ends, self.semi
        for c in super().codes(text):
            if c & 1 and out and out[-1] in ends:
                out.append(semi)
            out.append(c & -2)
        if out and out[-1] in ends:
            out.append(semi)
        return out


class Script(Language):
    def __init__(self, text: str, words: list[str]):
        super().__init__(_SCRIPT, text, words, "RAYLN")
        self.start_flags = self.grammar.flag["A"]

    def raw(self, tok: str) -> int:
        return _PARTS if any(m[1] is not None for m in _HOLES.finditer(tok)) else self.c["TMPL"]

    def parts(self, tok: str) -> int:
        g, holes = self.grammar, []
        for m in _HOLES.finditer(tok):
            if m[1] is not None:
                inner = self.folded(m[1])
                holes.append(g.shape("`", list(inner) if inner is not None else [self.c["BAD"]]))
        return g.shape("`", holes)

    def codes(self, text: str) -> list[int]:
        text = text.removeprefix("\ufeff")
        return super().codes(text[text.find("\n") :] if text.startswith("#!") else text)

    def valid(self, text: str) -> bool:
        """The one pattern is right about most texts; where it finds an error, templates and
        regular expressions are told from the tokens before them, at any depth, before it counts."""
        if super().valid(text):
            return True
        if "`" not in text and "/" not in text:
            return False
        text = text.removeprefix("\ufeff")
        codes, _ = self._exact(text[text.find("\n") :] if text.startswith("#!") else text, 0, False)
        content = self.grammar.fold(codes, self.opens, self.closes)
        return content is not None and self.grammar.derives("file", self.start_flags, content)

    def _exact(self, text: str, at: int, hole: bool) -> tuple[list[int], int]:
        """(codes, end) from ``at``; a ``hole`` of a template ends at the brace that closes it."""
        frames: list[tuple[list[int], bool]] = []  # of enclosing templates: codes outside, and shapes so far
        out: list[int] = []
        stack: list[tuple[str, bool]] = []  # open brackets, and whether a value cannot stand before a slash after them
        templates: list[list[int]] = []
        prev, nl, n = "", 0, len(text)
        while at < n:
            if text[at] == "`" or (text[at] == "}" and stack and stack[-1][0] == "${"):
                if text[at] == "`":
                    templates.append([])
                    frames.append((out, bool(nl)))
                else:
                    stack.pop()
                    inner = self.grammar.fold(out, self.opens, self.closes)
                    templates[-1].append(self.grammar.shape("`", list(inner) if inner is not None else [self.c["BAD"]]))
                m = _TEMPLATE.match(text, at + 1)
                at = m.end()
                if m[1] == "${":
                    stack.append(("${", True))
                    out, prev, nl = [], "", 0
                    continue
                outer, before = frames.pop()
                holes = templates.pop()
                if m[1] is None:
                    return [self.c["BAD"]], n
                out = outer
                out.append((self.grammar.shape("`", holes) if holes else self.c["TMPL"]) | before)
                prev, nl = "`", 0
                continue
            if text[at] == "/" and (prev == "" or prev in _VALUE_NEXT or not (prev[0] in ")]}`\"'/" or prev[0].isalnum() or prev[0] in "_$#" or prev in ("++", "--"))):
                m = _REGEX.match(text, at)
                if m:
                    out.append(self.c["RE"] | nl)
                    at, prev, nl = m.end(), "/r", 0
                    continue
            if text[at] in " \t\r":
                at += 1
                continue
            m = _EXACT.match(text, at)
            if m is None:
                at += 1
                continue
            tok, at = m[1], m.end()
            c = self.classify(tok) if tok != "/" else self.grammar.code["/"]
            if c == _LINE:
                nl = 1
            if c < 0:
                continue
            out.append(c | nl)
            nl = 0
            if tok in "([{":
                block = tok == "{" and (prev in ("", ")", ";", "{", "}", "else", "do", "try", "finally", ":") or prev == "/b")
                stack.append((tok, (tok == "(" and prev in ("if", "while", "for", "with")) or block))
            elif tok in ")]}" and stack and stack[-1][0] != "${":
                tok = "" if stack.pop()[1] else tok  # after a head or a block an expression begins
            prev = tok
        return (out if not frames else [self.c["BAD"]]), at


_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_EXACT = re.compile(_SCRIPT.pattern.replace(_SCRIPT.pattern[_SCRIPT.pattern.index("|(?:(?<=[") : _SCRIPT.pattern.index("|\\#?(?:[^")], ""))
_VALUE_NEXT = frozenset("return typeof case in of delete void throw new instanceof else do yield await".split())


def _python():
    from tessera.llm.syntax.python import Python

    return Python()


MAKERS = {
    "python": _python,
    "proto": lambda: Language(_PROTO, grammars.PROTO, grammars.PROTO_WORDS, ""),
    "go": Go,
    "javascript": lambda: Script(grammars.SCRIPT, grammars.SCRIPT_WORDS),
    "typescript": lambda: Script(grammars.TYPED, grammars.SCRIPT_WORDS + grammars.TYPED_WORDS),
}
