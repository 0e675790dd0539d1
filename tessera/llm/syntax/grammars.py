"""Grammars of proto3, Go, JavaScript modules and TypeScript, as far as syntax goes.

Operator precedence never decides whether a text parses, so binary expressions
are flat.  Token classes are in capitals: ID, NUM, STR, RE, BAD and so on.
"""

PROTO_WORDS = (
    "syntax import weak public package option message enum service rpc returns stream oneof map reserved to max repeated optional"
    " extend true false edition"
).split()

PROTO = r"""
file = (syntax / item)* ;
syntax = 'syntax' '=' STR+ ';' ;
item = imp / pack / option / message / enum / service / extend / ';' ;
imp = 'import' ('weak' / 'public')? STR+ ';' ;
pack = 'package' full ';' ;
name = ID / 'syntax' / 'import' / 'weak' / 'public' / 'package' / 'option' / 'message' / 'enum' / 'service' / 'rpc' / 'returns' / 'stream' / 'oneof' / 'map' / 'reserved' / 'to' / 'max' / 'repeated' / 'optional' / 'extend' / 'true' / 'false' / 'edition' ;
full = name ('.' name)* ;
type = '.'? full ;
optname = (name / P<type>) ('.' (name / P<type>))* ;
option = 'option' optname '=' const ';' ;
const = ('-' / '+')? NUM / ('-' / '+')? full / STR+ / B<aggregate> ;
aggregate = (aggkey (':' aggval / B<aggregate> / ':'? S<agglist>) (',' / ';')?)* ;
aggkey = name / S<aggext> ;
aggext = full ('/' full)? ;
aggval = const / S<agglist> ;
agglist = (aggval (',' aggval)*)? ;
message = 'message' name B<body> ;
body = (message / enum / extend / option / oneof / mapfield / reserved / field / ';')* ;
field = ('repeated' / 'optional')? !(('message' / 'enum' / 'service' / 'rpc') name B<any>) type name '=' NUM opts? ';' ;
any = anytok* ;
anytok = name / NUM / STR / P<any> / B<any> / S<any> / '=' / ';' / ',' / '.' / '<' / '>' / ':' / '-' / '+' / '/' ;
opts = S<optlist> ;
optlist = optname '=' const (',' optname '=' const)* ;
oneof = 'oneof' name B<ones> ;
ones = (option / onefield / ';')* ;
onefield = type name '=' NUM opts? ';' ;
mapfield = 'map' '<' name ',' type '>' name '=' NUM opts? ';' ;
reserved = 'reserved' (ranges / STR (',' STR)* / name (',' name)*) ';' ;
ranges = range (',' range)* ;
range = '-'? NUM ('to' ('-'? NUM / 'max'))? ;
enum = 'enum' name B<enums> ;
enums = (option / reserved / name '=' '-'? NUM opts? ';' / ';')* ;
service = 'service' name B<rpcs> ;
rpcs = (option / rpc / ';')* ;
rpc = 'rpc' name P<msg> 'returns' P<msg> (B<rpcbody> / ';') ;
msg = 'stream' !end type / type ;
rpcbody = (option / ';')* ;
extend = 'extend' type B<extends> ;
extends = (field / ';')* ;
"""

GO_WORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return"
    " select struct switch type var"
).split()

#: Flag C: a composite literal may follow a bare type name.
GO = r"""
file = 'package' ID ';' (import ';')* (decl ';')* ;
import = 'import' (impspec / P<impspecs>) ;
impspecs = (impspec (';' impspec)* ';'?)? ;
impspec = ('.' / ID)? STR ;
decl = func / tconst / tvar / ttype ;
tconst = 'const' (cspec / P<cspecs>) ;
cspecs = (cspec (';' cspec)* ';'?)? ;
cspec = ids (type? '=' exprs)? ;
tvar = 'var' (vspec / P<vspecs>) ;
vspecs = (vspec (';' vspec)* ';'?)? ;
vspec = ids (type ('=' exprs)? / '=' exprs) ;
ttype = 'type' (tspec / P<tspecs>) ;
tspecs = (tspec (';' tspec)* ';'?)? ;
tspec = ID (S<tparams> '='? type / '='? type) ;
tparams = tparam (',' tparam)* ','? ;
tparam = ids constraint ;
constraint = '~'? type ('|' '~'? type)* ;
ids = ID (',' ID)* ;
func = 'func' P<recv>? ID S<tparams>? sig B<block>? ;
recv = ID type ','? / type ','? ;
sig = P<params> (P<params> / type)? ;
params = (param (',' param)* ','?)? ;
param = ID '...' type / '...' type / ID type / type ;
type = 'func' sig / 'struct' B<fields> / 'interface' B<methods> / 'map' S<type> type / '<-' 'chan' type / 'chan' '<-'? type / '*' type / S<length> type / P<type> / qual S<types>? ;
qual = ID ('.' ID)? ;
types = type (',' type)* ','? ;
length = ('...' / expr)? ;
fields = (fieldd (';' fieldd)* ';'?)? ;
fieldd = (ids type / '*'? qual S<types>? / P<type>) STR? ;
methods = (method (';' method)* ';'?)? ;
method = ID sig / constraint ;
block = stmts ;
stmts = (stmt (';' stmt)*)? ';'? ;
stmt = tconst / tvar / ttype / 'return' exprs:C? / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough' / ('go' / 'defer') expr:C / B<block:C> / if / switch / select / for / label / simple:C / ;
label = ID ':' stmt ;
simple = exprs (':=' exprs / assign exprs / '++' / '--' / '<-' expr)? ;
assign = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=' ;
if = 'if' (simple:c? ';')? expr:c B<block:C> ('else' (if / B<block:C>))? ;
switch = 'switch' ((simple:c? ';')? tguard B<tcases:C> / (simple:c? ';')? simple:c? B<cases:C>) ;
tguard = (ID ':=')? operand:c tail:c* '.' P<typekw> ;
typekw = 'type' ;
cases = (('case' exprs:C / 'default') ':' stmts)* ;
tcases = (('case' typeornil (',' typeornil)* / 'default') ':' stmts)* ;
typeornil = type ;
select = 'select' B<comms:C> ;
comms = (('case' simple:C / 'default') ':' stmts)* ;
for = 'for' (B<block:C> / range B<block:C> / simple:c? ';' expr:c? ';' simple:c? B<block:C> / expr:c B<block:C>) ;
range = (exprs:c (':=' / '='))? 'range' expr:c ;
exprs = expr (',' expr)* ;
expr = unary (binop unary)* ;
binop = '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^' ;
unary = ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~')* primary ;
primary = operand tail* ;
operand = NUM / STR / CHAR / 'func' sig B<block:C> / lit / conv / ID / P<exprortype:C> ;
exprortype = expr / type ;
lit = 'struct' B<fields> B<elements:C> / 'map' S<type> type B<elements:C> / S<length> type B<elements:C> / %C qual S<types>? B<elements:C> ;
conv = ('map' S<type> type / S<length> type / 'chan' '<-'? type / 'interface' B<methods> / 'struct' B<fields> / 'func' sig) P<args:C> / 'map' S<type> type / S<length> type / 'chan' '<-'? type / 'struct' B<fields> / 'interface' B<methods> ;
elements = (element (',' element)* ','?)? ;
element = (elem ':')? elem ;
elem = B<elements:C> / expr:C ;
tail = '.' ID / '.' P<type> / S<index:C> / P<args:C> ;
index = expr? ':' expr? (':' expr)? / exprortype (',' type)* ','? ;
args = (arg (',' arg)* '...'? ','?)? ;
arg = expr / type ;
"""

SCRIPT_WORDS = (
    "async await break case catch class const continue debugger default delete do else export extends false finally for function if"
    " import in instanceof let new null return static super switch this throw true try typeof var void while with yield from as of get"
    " set enum"
).split()

TYPED_WORDS = (
    "type interface namespace module declare abstract implements public private protected readonly override keyof unique infer is"
    " asserts satisfies global accessor out require"
).split()

#: Flags: R return, A await as an operator, Y yield as an operator, L break and continue, N no `in` operator, C inside a class.
_SCRIPT = r"""
file = item:A* ;
semi = ';' / nl ;
item = import / export / stmt ;
import = 'import' !'.' !P<args> (TYPEONLY STR / TYPEONLY clause 'from' STR) ('with' B<obj>)? semi ;
clause = word ',' (B<specs> / '*' 'as' word) / word / B<specs> / '*' 'as' word ;
specs = (spec (',' spec)* ','?)? ;
spec = TYPEONLY (name / STR) 'as' (name / STR) / TYPEONLY (name / STR) ;
export = 'export' (EXPORTMORE '*' ('as' (name / STR))? 'from' STR semi / B<specs> ('from' STR)? semi / 'default' (func / class / DEFAULTMORE fexpr / cexpr / !('function' / 'class') assign semi) / decl) ;
decl = vars semi / func / class DECLMORE ;
vars = ('var' / 'let' / CONSTLET) bind (',' bind)* / 'const' cbind (',' cbind)* ;
bind = S<arrpat> ANNOT '=' assign / B<objpat> ANNOT '=' assign / word BANG ANNOT ('=' assign)? ;
cbind = target ANNOT '=' assign ;
target = word / S<arrpat> / B<objpat> ;
arrpat = (','* patelem (','+ patelem)* ','*)? / ','* ;
patelem = '...'? target ('=' assign)? ;
objpat = (patprop (',' patprop)* ','?)? ;
patprop = '...' target / prop ':' target ('=' assign)? / word ('=' assign)? ;
word = ID / 'from' / 'as' / 'of' / 'get' / 'set' / 'async' / 'static' WORDMORE ;
name = word / KEYWORD ;
KEYWORD = 'await' / 'break' / 'case' / 'catch' / 'class' / 'const' / 'continue' / 'debugger' / 'default' / 'delete' / 'do' / 'else' / 'export' / 'extends' / 'false' / 'finally' / 'for' / 'function' / 'if' / 'import' / 'in' / 'instanceof' / 'let' / 'new' / 'null' / 'return' / 'super' / 'switch' / 'this' / 'throw' / 'true' / 'try' / 'typeof' / 'var' / 'void' / 'while' / 'with' / 'yield' / 'enum' ;
func = asyncfn / 'function' ('*' word TP P<params> RET B<body:RYal> / word TP P<params> RET (B<body:Rayl> NOBODY)) ;
asyncfn = 'async' !nl 'function' ('*' word TP P<params> RET B<body:RAYl> / word TP P<params> RET (B<body:RAyl> NOBODY)) ;
body = stmt* ;
params = (param (',' param)* ','?)? ;
param = PARAMMODS '...'? (target / THISPARAM) OPT ANNOT ('=' assign)? ;
block = stmt* ;
stmt = B<block> / ';' / vars semi / func / class STMTMORE / if / for / while / dowhile / switch / try / 'throw' !nl expr semi / %R 'return' (!nl !';' expr)? semi / %L ('break' / 'continue') (!nl word)? semi / 'break' !nl word semi / 'debugger' semi / word ':' stmt / !('function' / 'class') exprn semi ;
exprn = !B<any2> expr ;
if = 'if' P<expr:n> stmt ('else' stmt)? ;
while = 'while' P<expr:n> stmt:L ;
dowhile = 'do' stmt:L 'while' P<expr:n> ';'? ;
for = 'for' ('await' P<forin> / P<forin> / P<forc>) stmt:L ;
forin = (('var' / 'let' / 'const') target ANNOT / lhs) ('of' assign / 'in' expr:n) ;
forc = (vars:N / expr:N)? ';' expr:n? ';' expr:n? ;
switch = 'switch' P<expr:n> B<cases:L> ;
cases = (('case' expr:n / 'default') ':' stmt*)* ;
try = 'try' B<block> ('catch' (P<catchp>)? B<block> ('finally' B<block>)? / 'finally' B<block>) ;
catchp = target ANNOT ;
expr = assign (',' assign)* ;
assign = arrow / %Y 'yield' (!nl ('*'? assign))? / lhs assignop assign / cond ;
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' '>' '>=' / '>' '>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' ;
arrow = 'async' !nl (word / ATP P<params>  ARET) !nl '=>' arrowbodya / (word / ATP P<params> ARET) !nl '=>' arrowbody ;
arrowbody = B<body:Raly> / !B<any2> assign:ray ;
arrowbodya = B<body:RAly> / !B<any2> assign:rAy ;
cond = bin ('?' assign:n ':' assign / '?' plain:n ':' assign)? ;
plain = lhs assignop assign / cond ;
bin = unary (binop unary / ASTYPE)* ;
binop = '||' / '&&' / '??' / '|' / '^' / '&' / '==' / '!=' / '===' / '!==' / '<=' / '<<' / '<' / '>=' / '>' '>' '>' / '>' '>' / '>' / 'instanceof' / !%N_IN 'in' / '+' / '-' / '*' / '/' / '%' / '**' ;
unary = ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / %A 'await' / CAST)* postfix ;
postfix = lhs (!nl ('++' / '--'))? ;
lhs = ('new' !'.')* primary tail* ;
tail = '.' (name / PRIV) / '?.' (name / PRIV / P<args> / S<expr:n>) / S<expr:n> / P<args:n> / STRT / TAILMORE ;
args = ('...'? assign (',' '...'? assign)* ','?)? ;
STRT = TMPL / T<tparts> ;
tparts = T<texpr>* ;
texpr = expr ;
primary = fexpr / cexpr / 'async' !nl P<args:n> / word / NUM / STR / RE / STRT / S<arr:n> / B<obj:n> / P<expr:n> / 'this' / 'super' / 'null' / 'true' / 'false' / 'import' ('.' name / P<args:n>) / 'new' '.' name / PRIV / 'let' ;
fexpr = 'async' !nl 'function' ('*' word? TP P<params> RET B<body:RAYl> / word? TP P<params> RET B<body:RAyl>) / 'function' ('*' word? TP P<params> RET B<body:RYal> / word? TP P<params> RET B<body:Rayl>) ;
arr = (','* '...'? assign (','+ '...'? assign)* ','*)? / ','* ;
obj = (oprop (',' oprop)* ','?)? ;
oprop = '...' assign / ('get' / 'set') prop P<params> RET B<body:Rayl> / 'async' !nl '*' prop TP P<params> RET B<body:RAYl> / 'async' !nl prop TP P<params> RET B<body:RAyl> / '*' prop TP P<params> RET B<body:RYal> / prop TP P<params> RET B<body:Rayl> / prop ':' assign / word ('=' assign)? ;
prop = name / STR / NUM / S<assign> ;
class = DECOR CLASSMODS 'class' word TP heritage B<members> ;
cexpr = DECOR 'class' (word)? TP heritage B<members> ;
heritage = ('extends' lhs HERITAGEARGS)? IMPL ;
members = (';' / member)* ;
member = DECOR ('static' B<block:raly> / MEMMODS (('get' / 'set') mname P<params> RET (B<body:Rayl> NOBODY) / 'async' !nl '*' mname TP P<params> RET (B<body:RAYl> NOBODY) / 'async' !nl mname OPT TP P<params> RET (B<body:RAyl> NOBODY) / '*' mname TP P<params> RET (B<body:RYal> NOBODY) / mname OPT TP P<params> RET (B<body:Rayl> NOBODY) / mname OPT BANG ANNOT ('=' assign)? semi INDEXMORE)) ;
mname = prop / PRIV ;
"""

_PLAIN = {
    "TYPEONLY": "", "EXPORTMORE": "", "DEFAULTMORE": "", "DECLMORE": "", "CONSTLET": "'let'", "ANNOT": "", "BANG": "", "WORDMORE": "",
    "TP": "", "RET": "", "NOBODY": "", "PARAMMODS": "", "THISPARAM": "'super' 'super' 'super'", "OPT": "", "STMTMORE": "", "ATP": "", "ARET": "",
    "ASTYPE": "BAD BAD", "CAST": "BAD BAD BAD", "TAILMORE": "BAD BAD BAD", "DECOR": "('@' lhs)*", "CLASSMODS": "", "HERITAGEARGS": "", "IMPL": "",
    "MEMMODS": "(('static') !('=' / ';' / P<any2> / nl))?", "INDEXMORE": "",
}

_TYPED = {
    "TYPEONLY": "('type' !('from' STR) !(',') !end !('as' name end) !('as' name ','))?",
    "EXPORTMORE": "'type'?",
    "DEFAULTMORE": "interface / 'abstract' class / ",
    "DECLMORE": "/ tdecl / 'type' B<specs> ('from' STR)? semi / '=' expr semi / 'as' 'namespace' word semi / import",
    "CONSTLET": "'let'",
    "ANNOT": "(':' type)?",
    "BANG": "'!'?",
    "WORDMORE": "/ 'type' / 'interface' / 'namespace' / 'module' / 'declare' / 'abstract' / 'implements' / 'public' / 'private' / 'protected' / 'readonly' / 'override' / 'keyof' / 'unique' / 'infer' / 'is' / 'asserts' / 'satisfies' / 'global' / 'accessor' / 'out' / 'require'",
    "TP": "tparams?",
    "RET": "(':' rtype)?",
    "NOBODY": "/ semi",
    "PARAMMODS": "('@' lhs)* (('public' / 'private' / 'protected' / 'readonly' / 'override') !(':' / ',' / '=' / '?' / end))*",
    "THISPARAM": "'this'",
    "OPT": "'?'?",
    "STMTMORE": "/ tdecl",
    "ATP": "tparams?",
    "ARET": "(':' rtype)?",
    "ASTYPE": "!nl ('as' / 'satisfies') ('const' / type)",
    "CAST": "'<' type '>' !P<any2> / '<' type '>' &P<expr>",
    "TAILMORE": "!nl '!' / targs &(P<args> / TMPL / T<tparts>)",
    "DECOR": "('@' lhs)*",
    "CLASSMODS": "'declare'? 'abstract'?",
    "HERITAGEARGS": "targs?",
    "IMPL": "('implements' tref (',' tref)*)?",
    "MEMMODS": "(('public' / 'private' / 'protected' / 'static' / 'readonly' / 'abstract' / 'override' / 'declare' / 'accessor') !('=' / ';' / ':' / '?' / '!' / '<' / P<any2> / nl))*",
    "INDEXMORE": "/ S<indexer> ':' type semi",
}

_TYPES = r"""
any2 = anytok2* ;
anytok2 = tok ;
tdecl = interface / typealias / tenum / tnamespace / 'declare' tdeclared / 'abstract' class / 'import' word '=' ('require' P<args> / qname) semi ;
tdeclared = 'global' B<items> / tnamespace / interface / typealias / tenum / func / class / ('var' / 'let' / 'const') word ANNOTX (',' word ANNOTX)* semi ;
ANNOTX = (':' type)? ('=' assign)? ;
items = item* ;
interface = 'interface' word tparams? ('extends' tref (',' tref)*)? B<tmembers> ;
typealias = 'type' word tparams? '=' type semi ;
tenum = 'const'? 'enum' word B<enumers> ;
enumers = (enumer (',' enumer)* ','?)? ;
enumer = (name / STR / S<assign>) ('=' assign)? ;
tnamespace = ('namespace' / 'module') (qname / STR) (B<items> / semi) ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = ('const' / 'in' !(',' / '>') / 'out')* word ('extends' type)? ('=' type)? ;
targs = '<' type (',' type)* ','? '>' ;
qname = name ('.' name)* ;
tref = qname targs? ;
rtype = 'asserts' !nl (word / 'this') ('is' type)? / (word / 'this') 'is' type / type ;
type = tfunc / tunion ('extends' tunion '?' type ':' type)? ;
tfunc = 'abstract'? 'new' tparams? P<params> '=>' rtype / tparams? P<params> '=>' rtype ;
tunion = ('|' / '&')? tpart (('|' / '&') tpart)* ;
tpart = ('keyof' / 'readonly' / 'unique')* ('infer' word ('extends' tpart !'?')? / tpost) ;
tpost = tprim (!nl S<tindex>)* ;
tindex = type? ;
tprim = tfunc / P<type> / S<ttuple> / B<tmapped> / B<tmembers> / 'typeof' ('import' P<args> ('.' qname)? / 'this' ('.' name)* / qname) targs? / 'import' P<args> ('.' qname)? targs? / STR / '-'? NUM / TMPL / T<ttparts> / 'true' / 'false' / 'null' / 'this' / 'void' / tref ;
ttparts = T<ttype>* ;
ttype = type ;
ttuple = (ttel (',' ttel)* ','?)? ;
ttel = '...'? (name '?'? ':' type / type '?'?) ;
tmapped = (('-' / '+')? 'readonly')? S<tmapkey> (('-' / '+')? '?')? (':' type)? (';' / ',')? ;
tmapkey = word 'in' type ('as' type)? ;
tmembers = (tmember (';' / ',' / nl))* ;
tmember = 'new' tparams? P<params> (':' rtype)? / tparams? P<params> (':' rtype)? / ('get' / 'set') mname P<params> (':' rtype)? / 'readonly'? S<indexer> (':' type)? / ('readonly' !(':' / '?' / P<any2> / '<'))? mname '?'? (tparams? P<params> (':' rtype)? / (':' type)?) ;
indexer = word ':' type ;
"""


def script(parts: dict[str, str]) -> str:
    import re

    text = _SCRIPT.replace("!%N_IN 'in'", "inop")
    # longest names first, whole words only
    for k in sorted(parts, key=len, reverse=True):
        text = re.sub(rf"\b{k}\b", lambda _: parts[k], text)
    return text + "inop = noin 'in' ;\nnoin = !%N ;\n"


SCRIPT = script(_PLAIN) + "any2 = anytok2* ;\nanytok2 = tok ;\n"
TYPED = script(_TYPED) + _TYPES
