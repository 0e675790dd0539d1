"""Python 3: its grammar as a text, and its token stream.

Logical lines and indented blocks are groups like those of brackets, so a line or
a block of a form met before is an entry of the chart.  Formatted strings are
scanned with a stack of their own; the expressions in them are groups, too.
"""

from __future__ import annotations

import re

from tessera.llm.syntax.lexers import Language

WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is"
    " lambda nonlocal not or pass raise return try while with yield match case type"
).split()

#: Heads of compound statements; the body is a block, or simple statements on the line.
_HEADS = {
    "ifc": "'if' named", "elifc": "'elif' named", "elsec": "'else'", "whilec": "'while' named", "tryc": "'try'", "finallyc": "'finally'",
    "forc": "'async'? 'for' targets 'in' exprs",
    "withc": "'async'? 'with' (P<withitems> &(':' ) / withitem (',' withitem)*)",
    "exceptc": "'except' (expr ('as' name)?)?", "groupc": "'except' '*' expr ('as' name)?",
    "funcc": "'async'? 'def' name S<tparams>? P<params> ('->' expr)?", "classc": "'class' name S<tparams>? P<args>?",
    "casec": "'case' patterns ('if' named)?",
}

GRAMMAR = r"""
file = stmt* ;
block = stmt+ ;
stmt = L<simples> / if / while / for / with / try / L<decorator>+ (funcc / classc) / funcc / classc / L<subject> I<cases> ;
if = ifc elifc* elsec? ;
while = whilec elsec? ;
for = forc elsec? ;
with = withc ;
try = tryc (groupc+ elsec? finallyc? / exceptc+ elsec? finallyc? / finallyc) ;
decorator = '@' named ;
subject = 'match' (starnamed ',' (starnamed (',' starnamed)* ','?)? / named) ':' ;
cases = casec+ ;
simples = simple (';' simple)* ';'? ;
simple = assignment / alias / exprs / 'return' exprs? / imports / 'raise' (expr ('from' expr)?)? / 'pass' / 'break' / 'continue' / 'del' dtarget (',' dtarget)* ','? / yield / 'assert' expr (',' expr)? / ('global' / 'nonlocal') name (',' name)* ;
assignment = name ':' expr ('=' value)? / (P<single> / placed) ':' expr ('=' value)? / single augment value / (targets '=')+ value !'=' ;
value = yield / exprs ;
augment = '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//=' ;
alias = 'type' name S<tparams>? '=' expr ;
yield = 'yield' ('from' expr / exprs?) ;
imports = 'import' module ('as' name)? (',' module ('as' name)?)* / 'from' (('.' / '...')* module / ('.' / '...')+) 'import' ('*' / P<names> / imported (',' imported)*) ;
module = name ('.' name)* ;
names = imported (',' imported)* ','? ;
imported = name ('as' name)? ;
name = ID / 'match' / 'case' / 'type' ;
targets = target (',' target)* ','? ;
target = '*' !'*' target / placed / name !trailer / P<ptarget> !trailer / S<ltarget> !trailer ;
ptarget = end / !'*' target end / target (',' target)+ ','? / target ',' ;
ltarget = (target (',' target)* ','?)? ;
placed = atom (trailer &trailer)* ('.' name / S<slices>) ;
single = placed / name !trailer / P<single> !trailer ;
dtarget = placed / name !trailer / P<dtargets> !trailer / S<dtargets> !trailer ;
dtargets = (dtarget (',' dtarget)* ','?)? ;
exprs = starexpr (',' starexpr)* ','? ;
starexpr = '*' bitor / expr ;
starnamed = '*' bitor / named ;
named = name ':=' expr / expr !':=' ;
expr = 'lambda' lparams? ':' expr / disj ('if' disj 'else' expr)? ;
disj = conj ('or' conj)* ;
conj = inv ('and' inv)* ;
inv = 'not'* comp ;
comp = bitor (('==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is') bitor)* ;
bitor = unary (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '//' / '/' / '%' / '@') unary)* ;
unary = ('+' / '-' / '~')* 'await'? atom trailer* ('**' unary)? ;
trailer = '.' name / P<args> / S<slices> ;
atom = name / strings / NUM / 'None' / 'True' / 'False' / '...' / P<paren> / S<list> / B<braces> ;
strings = BYTES+ / (STR / T<holes>)+ ;
holes = T<hole>* ;
hole = (yield / exprs) '='? ;
paren = end / yield end / named comps end / named end / starnamed ',' (starnamed (',' starnamed)* ','?)? ;
list = named comps end / (starnamed (',' starnamed)* ','?)? ;
braces = end / pair comps end / (pair / '**' bitor) (',' (pair / '**' bitor))* ','? end / named comps end / starnamed (',' starnamed)* ','? ;
pair = expr ':' expr ;
comps = comp1+ ;
comp1 = 'async'? 'for' targets 'in' disj ('if' disj)* ;
slices = (slice / '*' bitor) (',' (slice / '*' bitor))* ','? ;
slice = expr? ':' expr? (':' expr?)? / named ;
args = end / named comps end / (parg (',' parg)* (',' kwargs)? / kwargs) ','? ;
parg = '*' expr / (name ':=' expr / expr !':=') !'=' ;
kwargs = kwstar (',' kwstar)* (',' kwtwo (',' kwtwo)*)? / kwtwo (',' kwtwo)* ;
kwstar = name '=' expr / '*' expr ;
kwtwo = name '=' expr / '**' expr ;
params = end / pos (',' rest)? ','? / rest ','? ;
pos = pn (',' pn)* ',' '/' (',' pn)* (',' pd)* / pn (',' pn)* (',' pd)+ ',' '/' (',' pd)* / pd (',' pd)* ',' '/' (',' pd)* / pn (',' pn)* (',' pd)* / pd (',' pd)* ;
pn = name (':' expr)? !'=' ;
pd = name (':' expr)? '=' expr ;
rest = '*' name (':' starexpr)? (',' (pd / pn))* (',' two)? / '*' (',' (pd / pn))+ (',' two)? / two ;
two = '**' name (':' expr)? ;
lparams = lpos (',' lrest)? ','? / lrest ','? ;
lpos = ln (',' ln)* ',' '/' (',' ln)* (',' ld)* / ln (',' ln)* (',' ld)+ ',' '/' (',' ld)* / ld (',' ld)* ',' '/' (',' ld)* / ln (',' ln)* (',' ld)* / ld (',' ld)* ;
ln = name !'=' ;
ld = name '=' expr ;
lrest = '*' name (',' (ld / ln))* (',' '**' name)? / '*' (',' (ld / ln))+ (',' '**' name)? / '**' name ;
tparams = tparam (',' tparam)* ','? ;
tparam = '**' name ('=' expr)? / '*' name ('=' starexpr)? / name (':' expr)? ('=' expr)? ;
withitems = withitem (',' withitem)* ','? ;
withitem = expr 'as' target / expr ;
patterns = starpat ',' (starpat (',' starpat)* ','?)? / pattern ;
starpat = '*' name / pattern ;
pattern = closed ('|' closed)* ('as' name)? ;
closed = literal / name ('.' name)* P<cargs>? / P<pseq> / S<pseq> / B<pmap> ;
literal = '-'? NUM (('+' / '-') NUM)? / strings / 'None' / 'True' / 'False' ;
pseq = (starpat (',' starpat)* ','?)? ;
pmap = (pkey (',' pkey)* ','?)? ;
pkey = (literal / name ('.' name)+) ':' pattern / '**' name ;
cargs = end / !(name '=') pattern (',' !(name '=') pattern)* (',' ckey)* ','? / ckey (',' ckey)* ','? ;
ckey = name '=' pattern ;
"""
GRAMMAR += "".join(f"{k} = L<{k}h> I<block> / L<{k}s> ;\n{k}h = {v} ':' ;\n{k}s = {v} ':' simples ;\n" for k, v in _HEADS.items())

_LONG = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' + r"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_SHORT = r'"(?:[^"\\\n]|\\[\s\S])*"' + r"|'(?:[^'\\\n]|\\[\s\S])*'"
_PLAIN = rf"(?:[uU]|[bB][rR]?|[rR][bB]?)?(?:{_LONG}|{_SHORT})"
_FORMAT = r"(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|')"
_NUMBER = (
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
)
#: The place of a formatted string, by its number.
_MARK = "%d"
_FIELDS = r"(?:[fF][rR]?|[rR][fF])(?:%s)" % "|".join(rf"{q}(?!{q}{q})(?:[^{q}\\\n{{}}]|\{{\{{|\}}\}}|\{{[^{{}}\"'\\\n]*\}})*{q}" for q in "\"'")
#: Blanks are passed with the token behind them; names, the most frequent tokens, are tried first.
_TOKEN = re.compile(
    rf"[ \t\f]*([^\W\d]\w*+(?![\"'])|[()\[\]{{}},]|:(?!=)|\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*|{_PLAIN}|{_FIELDS}|{_FORMAT}|[^\W\d]\w*"
    rf"|(?:{_NUMBER})(?=(?:and|else|for|if|in|is|not|or)\b)|(?:{_NUMBER})\w*|\#[^\n]*|\\\n|\ue000\d+\ue001"
    r"|\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|!=|==|<=|>=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[^\s])"
)
_SKELETON = re.compile(rf"#[^\n]*|(?<!\w)(?:({_FORMAT})|{_PLAIN})|(?<=\w)(?:{_LONG}|{_SHORT})")
_VALID_NUMBER = re.compile(rf"(?:{_NUMBER})")
_OLD_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:0010|000[0-9a-fA-F])[0-9a-fA-F]{4})|N(?!\{[^{}\n]+\}))")
_BAD_BYTE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_INNER = re.compile(rf"({_FORMAT})|{_PLAIN}|[^\W\d]\w*|!=|==|<=|>=|:=|#[^\n]*|[\s\S]")
_OPENING = re.compile(_FORMAT)
_NEWLINE, _SKIP = -2, -4


class Unplaced(Exception):
    """A formatted string whose end no pattern tells."""


class Unclosed(Exception):
    """A formatted string that does not end as it must."""


def _hole(text: str, at: int, quote: str) -> tuple[str, list, int]:
    """(expression, inner strings, end) of a replacement field whose brace was just passed; ``end`` is behind its closing brace."""
    depth, start, out, n = 0, at, [], len(text)
    while at < n:
        m = _INNER.match(text, at)
        tok = m[0]
        if m[1]:
            inner, at2 = scan(text, m.end(), m[1])
            out.append((at - start, at2 - start, inner))
            at = at2
            continue
        if tok in "([{":
            depth += 1
        elif tok in ")]}" and depth:
            depth -= 1
        elif not depth and tok in "!:}":
            break
        elif len(quote) == 1 and tok == quote:
            raise Unclosed
        at = m.end()
    else:
        raise Unclosed
    expr = text[start:at]
    if text[at] == "!":
        m = re.compile(r"![sra](?=[:}])").match(text, at)
        if not m:
            raise Unclosed
        at = m.end()
    more: list = []
    if text[at] == ":":
        at += 1
        while True:
            if at >= n or (len(quote) == 1 and text[at] in quote + "\n"):
                raise Unclosed
            if text.startswith(quote, at):
                raise Unclosed
            if text[at] == "}":
                break
            if text[at] == "{":
                if text.startswith("{{", at):
                    at += 2
                    continue
                inner, strings, at = _hole(text, at + 1, quote)
                more.append((inner, strings))
                continue
            at += 1
    return (expr, out, at + 1) if not more else (expr, [*out, *(("spec", *x) for x in more)], at + 1)


def scan(text: str, at: int, opened: str) -> tuple[list, int]:
    """(fields, end) of a formatted string whose opening was just passed; a field is (expression, inner strings)."""
    quote, raw = opened.lstrip("fFrR"), "r" in opened.lower()
    fields, n = [], len(text)
    while at < n:
        if text.startswith(quote, at):
            return fields, at + len(quote)
        c = text[at]
        if c == "\\":
            if not raw and _BAD_ESCAPE.match(text, at):
                raise Unclosed
            if not raw and text.startswith("\\N{", at):
                at = text.find("}", at) + 1 or n
            else:
                at += 1 if text[at + 1 : at + 2] in ("{", "}") else 2
        elif c == "\n" and len(quote) == 1:
            raise Unclosed
        elif c in "{}":
            if text[at + 1 : at + 2] == c:
                at += 2
            elif c == "}":
                raise Unclosed
            else:
                expr, inner, at = _hole(text, at + 1, quote)
                fields.append((expr, inner))
        else:
            at += 1
    raise Unclosed


def _unix(text: str) -> str:
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


class Python(Language):
    def __init__(self):
        super().__init__(_TOKEN, GRAMMAR, WORDS, "", ("BYTES",))
        code = self.grammar.code_of
        self.line, self.eol, self.indent, self.dedent = (code(k) for k in ("<line>", "<eol>", "<indent>", "<dedent>"))
        self.opens |= {self.line: "L", self.indent: "I"}
        self.closes |= {self.eol: "L", self.dedent: "I"}
        self.deep, self.shallow = {code(k) for k in "([{"}, {code(k) for k in ")]}"}
        self.brackets = max(self.deep | self.shallow) + 2
        self.c["BYTES"] = code("BYTES")
        self.inserted = frozenset((self.line, self.eol, self.indent, self.dedent))

    def classify(self, tok: str) -> int:
        ch = tok[0]
        if ch == "\n":
            return _NEWLINE
        if ch == "#" or tok == "\\\n":
            return _SKIP
        if tok[-1] in "\"'":
            if len(tok) < 2:
                return self.c["BAD"]
            if tok[0] in "fFrR" and (m := _OPENING.match(tok)):
                if m.end() == len(tok):
                    raise Unplaced
                try:
                    return self._shape(scan(tok, m.end(), m[0])[0])
                except Unclosed:
                    return self.c["BAD"]
            prefix = tok[: min(tok.find(q) for q in "\"'" if q in tok)].lower()
            if "b" in prefix:
                bad = not tok.isascii() or ("r" not in prefix and "\\x" in tok and _BAD_BYTE.search(tok))
                return self.c["BAD" if bad else "BYTES"]
            return self.c["BAD" if "\\" in tok and "r" not in prefix and _BAD_ESCAPE.search(tok) else "STR"]
        if tok in self.words:
            return self.words[tok]
        if ch.isidentifier():
            return self.c["ID"]
        if ch.isdigit() or (ch == "." and len(tok) > 1 and tok[1].isdigit()):
            return self.c["NUM" if _VALID_NUMBER.fullmatch(tok) and not _OLD_OCTAL.fullmatch(tok) else "BAD"]
        code = self.grammar.code.get(tok)
        return self.c["BAD"] if code is None else code

    def _marked(self, text: str, strings: list[tuple[int, int, list]], shapes: list[int]) -> str:
        """The text with marks for its formatted strings, whose shapes are added."""
        out, at = [], 0
        for a, b, fields in strings:
            out += [text[at:a], _MARK % len(shapes)]
            at = b
            shapes.append(self._shape(fields))
        return "".join([*out, text[at:]])

    def _shape(self, fields: list) -> int:
        """The group of a formatted string: one inner group for each field, those of format specifications included."""
        g, holes, todo = self.grammar, [], list(reversed(fields))
        while todo:
            expr, inner = todo.pop()
            todo += [(x[1], x[2]) for x in inner if x[0] == "spec"]
            shapes: list[int] = []
            flat = [c for c in self._flat(self._marked(expr, [x for x in inner if x[0] != "spec"], shapes), shapes) if c not in self.inserted]
            folded = g.fold(flat, self.opens, self.closes)
            holes.append(g.shape("`", list(folded) if folded is not None else [self.c["BAD"]]))
        return g.shape("`", holes)

    def _prepared(self, text: str) -> tuple[str, list[int], list[int]]:
        """(text with marks for formatted strings, their shapes, the line breaks each mark hides)."""
        found, at = [], 0
        while True:
            m = _SKELETON.search(text, at)
            while m and not m[1]:
                m = _SKELETON.search(text, m.end())
            if not m:
                break
            try:
                fields, at = scan(text, m.end(), m[1])
            except Unclosed:
                raise Unclosed(text.count("\n", 0, m.start()) + 1) from None
            found.append((m.start(), at, fields))
        shapes: list[int] = []
        return "\n" + self._marked(text, found, shapes), shapes, [text.count("\n", a, b) for a, b, _ in found]

    def codes(self, text: str) -> list[int]:
        text = _unix(text)
        try:
            return self._flat("\n" + text, [])
        except Unplaced:
            pass
        try:
            marked, shapes, _ = self._prepared(text)
            return self._flat(marked, shapes)
        except Unclosed:
            return [self.c["BAD"]]

    def first_error(self, text: str) -> tuple[int, str]:
        """(line, reason): a token, a bracket, or the first logical line that no rule takes, else where the file's rule stops."""
        text = _unix(text)
        try:
            marked, shapes, hidden = self._prepared(text)
        except Unclosed as e:
            return e.args[0], "token"
        line, starts, stack, fresh, real = 0, [], [], True, [self.grammar.code_of(k) for k in "([{"]
        for m in self.pattern.finditer(marked):
            tok = m[1]
            if tok[0] == "\ue000" and len(tok) > 2:
                c = 1 << 30
            else:
                c = self.classify(tok)
            if c == self.c["BAD"]:
                return line, "token"
            if c >= 0 and fresh and not stack:
                starts.append(line)
                fresh = False
            if c in real:
                stack.append((self.opens[c], line))
            elif c in self.shallow:
                if not stack or stack.pop()[0] != self.closes[c]:
                    return line, "bracket"
            elif c == _NEWLINE and not stack:
                fresh = True
            line += hidden[int(tok[1:-1])] if c == 1 << 30 else tok.count("\n")
        if stack:
            return stack[-1][1], "bracket"
        g, content, n = self.grammar, self.folded(text), 0
        if content is None:
            return 1, "bracket"
        stop, known = g.rules["file"](content, 0, 0), g.by_shape()
        todo = [(content, True)]
        top: list[int] = []
        while todo:
            body, outer = todo.pop()
            for k, c in enumerate(body):
                kind, inner = g.contents[(c - g.base) >> 1] if c >= g.base else ("", ())
                if outer:
                    top.append(n)
                if kind == "L":
                    if n < len(starts) and not any(x[2] for x in known.get((c - g.base) >> 1, ())):
                        return starts[n], "grammar"
                    n += 1
                elif kind == "I":
                    todo += [(body[k + 1 :], outer), (inner, False)]
                    break
        at = top[min(stop, len(top) - 1)] if top else 0
        return (starts[min(at, len(starts) - 1)] if starts else 1), "grammar"

    def _flat(self, text: str, shapes: list[int]) -> list[int]:
        memo, out, classify = self.memo, [], self.classify
        if len(memo) > 200_000:
            memo.clear()
        get, add, deep, shallow = memo.get, out.append, self.deep, self.shallow
        depth, open_line, pending, widths, brackets = 0, False, "", [(0, 0)], self.brackets
        for tok in self.pattern.findall(text):
            c = get(tok)
            if c is None:
                if tok[0] == "" and len(tok) > 2:
                    c = shapes[int(tok[1:-1])]
                else:
                    c = classify(tok)
                    if 0 <= c < self.grammar.base and len(tok) < 40:  # shapes do not outlive their chart
                        memo[tok] = c
            if c >= 0:
                if not open_line:
                    margin = pending[pending.rfind("\n") + 1 :]
                    margin = margin[margin.rfind("\f") + 1 :]
                    at = (len(margin.expandtabs(8)), len(margin)) if margin else (0, 0)
                    if at != widths[-1]:
                        if at[0] > widths[-1][0] and at[1] > widths[-1][1]:
                            widths.append(at)
                            add(self.indent)
                        else:
                            while at[0] < widths[-1][0] and at[1] < widths[-1][1]:
                                widths.pop()
                                add(self.dedent)
                            if at != widths[-1]:
                                add(self.c["BAD"])
                    add(self.line)
                    open_line = True
                add(c)
                if c < brackets:
                    depth += 1 if c in deep else -1
            elif c == _NEWLINE and depth <= 0:
                if open_line:
                    add(self.eol)
                    open_line = False
                pending = tok
        if open_line:
            add(self.eol)
        out += [self.dedent] * (len(widths) - 1)
        return out
