"""Grammars of the languages whose files are checked, for ``derivatives.Grammar``.

Operators are kept flat (``operand { operator operand }``): precedence does not matter for validity, and flat chains let
different readings of the same tokens meet in the same state again.
"""

PYTHON = r"""
file = { NEWLINE | stmt } END ;
stmt = line | compound ;
line = small { ';' small } [ ';' ] NEWLINE ;
small = 'pass' | 'break' | 'continue' | 'return' [ stars ] | 'raise' [ expr [ 'from' expr ] ]
      | 'global' ID { ',' ID } | 'nonlocal' ID { ',' ID } | 'del' targets | 'assert' expr [ ',' expr ]
      | 'import' dotted [ 'as' ID ] { ',' dotted [ 'as' ID ] }
      | 'from' origin 'import' ( '*' | '(' names [ ',' ] ')' | names )
      | 'type' ID [ tparams ] '=' expr | assignment | yielding ;
origin = ( '.' | '...' ) { '.' | '...' } [ dotted ] | dotted ;
names = ID [ 'as' ID ] { ',' ID [ 'as' ID ] } ;
dotted = ID { '.' ID } ;
assignment = stars [ ':' expr [ '=' rhs ] | AUG rhs | '=' rhs { '=' rhs } ] ;
rhs = yielding | stars ;
yielding = 'yield' [ 'from' expr | stars ] ;
stars = star { ',' star } [ ',' ] ;
star = [ '*' ] expr ;
named = expr [ ':=' expr ] ;
starnamed = '*' expr | named ;
expr = 'lambda' [ lparams ] ':' expr | chain [ 'if' chain 'else' expr ] ;
chain = unary { binop unary } ;
unary = { '-' | '+' | '~' | 'not' } [ 'await' ] primary ;
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!='
      | 'in' | 'not' 'in' | 'is' [ 'not' ] | 'and' | 'or' ;
primary = atom { '.' ID | '(' [ args ] ')' | '[' subs ']' } ;
atom = ID | NUMBER | strings | '...' | 'None' | 'True' | 'False' | '(' [ inner ] ')' | '[' [ listed ] ']' | '{' [ braced ] '}' ;
strings = text { text } ;
text = STRING | FSTART { fpart } FEND ;
fpart = FMIDDLE | '{' ( yielding | stars ) [ '=' ] [ '!' ID ] [ ':' { fpart } ] '}' ;
inner = yielding | listed ;
listed = starnamed ( comps | { ',' starnamed } [ ',' ] ) ;
braced = listed | pair ( comps | { ',' pair } [ ',' ] ) ;
pair = expr ':' expr | '**' expr ;
comps = comp { comp } ;
comp = [ 'async' ] 'for' targets 'in' chain { 'if' cond } ;
cond = chain [ ':=' chain ] | 'lambda' [ lparams ] ':' expr ;
target = [ '*' ] primary ;
targets = target { ',' target } [ ',' ] ;
args = arg { ',' arg } [ ',' ] ;
arg = named [ comps ] | ID '=' expr | '*' expr | '**' expr ;
subs = sub { ',' sub } [ ',' ] ;
sub = starnamed | [ expr ] ':' [ expr ] [ ':' [ expr ] ] ;
suite = line | NEWLINE INDENT stmt { stmt } DEDENT ;
compound = 'if' named ':' suite { 'elif' named ':' suite } [ 'else' ':' suite ]
         | 'while' named ':' suite [ 'else' ':' suite ]
         | [ 'async' ] 'for' targets 'in' stars ':' suite [ 'else' ':' suite ]
         | [ 'async' ] 'with' ( withs | '(' withs [ ',' ] ')' ) ':' suite
         | 'try' ':' suite ( excepts [ 'else' ':' suite ] [ 'finally' ':' suite ] | 'finally' ':' suite )
         | { '@' named NEWLINE } ( [ 'async' ] 'def' ID [ tparams ] '(' [ params ] ')' [ '->' expr ] ':' suite
                                  | 'class' ID [ tparams ] [ '(' [ args ] ')' ] ':' suite )
         | 'match' starnamed { ',' starnamed } [ ',' ] ':' NEWLINE INDENT case { case } DEDENT ;
withs = with { ',' with } ;
with = expr [ 'as' target ] ;
excepts = except { except } ;
except = 'except' [ '*' ] [ expr [ 'as' ID ] ] ':' suite ;
params = param { ',' param } [ ',' ] ;
param = ID [ ':' expr ] [ '=' expr ] | '*' [ ID [ ':' [ '*' ] expr ] ] | '**' ID [ ':' expr ] | '/' ;
lparams = lparam { ',' lparam } [ ',' ] ;
lparam = ID [ '=' expr ] | '*' [ ID ] | '**' ID | '/' ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = [ '*' | '**' ] ID [ ':' expr ] [ '=' expr ] ;
case = 'case' pats [ 'if' named ] ':' suite ;
pats = pat { ',' pat } [ ',' ] ;
pat = [ '*' ] cpat { '|' cpat } [ 'as' ID ] ;
cpat = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | strings | 'None' | 'True' | 'False' | ID { '.' ID } [ '(' [ pargs ] ')' ]
     | '(' [ pats ] ')' | '[' [ pats ] ']' | '{' [ mpat { ',' mpat } [ ',' ] ] '}' ;
pargs = parg { ',' parg } [ ',' ] ;
parg = [ ID '=' ] pat ;
mpat = cpat ':' pat | '**' ID ;
"""

_ECMA = r"""
module = { item } END ;
item = import | export | stmt ;
eos = ';' | ASI ;
stmt = block | ';' | var eos | function | class | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt
     | 'do' stmt 'while' '(' expr ')' [ eos ] | 'for' [ 'await' ] '(' forhead ')' stmt
     | 'return' [ expr ] eos | 'break' [ ID ] eos | 'continue' [ ID ] eos | 'throw' expr eos | 'debugger' eos
     | 'try' block ( 'catch' [ '(' binding ann ')' ] block [ 'finally' block ] | 'finally' block )
     | 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' { stmt } } '}' | ID ':' stmt | exprstmt eos | tsstmt ;
block = '{' { stmt } '}' ;
var = ( 'var' | 'let' | 'const' ) decl { ',' decl } ;
decl = binding bang ann [ '=' assign ] ;
forhead = [ var | expr ] ';' [ expr ] ';' [ expr ] | ( 'var' | 'let' | 'const' ) binding ( 'of' assign | 'in' expr )
        | postfix ( 'of' assign | 'in' expr ) ;
binding = ID | '{' [ bprop { ',' bprop } [ ',' ] ] '}' | '[' belems ']' ;
bprop = '...' binding | key ':' binding [ '=' assign ] | ID [ '=' assign ] ;
belems = { ',' } [ belem { ',' [ belem ] } ] ;
belem = [ '...' ] binding [ '=' assign ] ;
expr = assign { ',' assign } ;
assign = operand { more } [ '?' assign ':' assign ] | yield ;
yield = 'yield' [ '*' ] [ assign ] ;
more = op ( operand | yield ) | astype ;
op = BINOP | '*' | '<' | '>' { '>' } [ '=' ] | '=' | ASSIGN | 'in' | 'instanceof' | '/' | '+' | '-' ;
operand = { prefix } postfix | arrow ;
prefix = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | cast ;
postfix = primary { suffix } ;
suffix = '.' ( NAME | PRIVATE ) | '?.' ( NAME | PRIVATE | '[' expr ']' | args | template ) | '[' expr ']' | args | template | '++' | '--' | tssuffix ;
args = '(' [ arg { ',' arg } [ ',' ] ] ')' ;
arg = [ '...' ] assign ;
primary = primarynb | object | functionexpr | classexpr ;
primarynb = ID | NUMBER | STRING | template | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | array | '(' expr ')'
          | 'import' ( '(' assign [ ',' assign ] [ ',' ] ')' | '.' NAME ) | 'new' '.' NAME | PRIVATE ;
exprstmt = startop { more } [ '?' assign ':' assign ] { ',' assign } | yield { ',' assign } ;
startop = prefix { prefix } postfix | primarynb { suffix } | arrow ;
array = '[' { ',' } [ arg { ',' [ arg ] } ] ']' ;
object = '{' [ prop { ',' prop } [ ',' ] ] '}' ;
prop = '...' assign | key ':' assign | ID [ '=' assign ] | [ 'async' ] [ '*' ] key method | ( 'get' | 'set' ) key method ;
key = NAME | STRING | NUMBER | '[' assign ']' ;
method = tparams '(' [ params ] ')' ret block ;
template = TEMPLATE | THEAD expr { TMIDDLE expr } TTAIL ;
arrow = [ 'async' ] ( ID | tparams '(' [ params ] ')' ret ) '=>' ( block | assign ) ;
params = param { ',' param } [ ',' ] ;
param = { decorator } modifiers [ '...' ] ( binding | tsthis ) opt ann [ '=' assign ] ;
function = [ 'async' ] 'function' [ '*' ] ID tparams '(' [ params ] ')' ret fbody ;
functionexpr = [ 'async' ] 'function' [ '*' ] [ ID ] tparams '(' [ params ] ')' ret fbody ;
class = { decorator } abstract 'class' ID tparams heritage '{' { member } '}' ;
classexpr = { decorator } 'class' [ ID ] tparams heritage '{' { member } '}' ;
heritage = [ 'extends' postfix targs ] implements ;
decorator = '@' ( '(' expr ')' | ID { '.' NAME } [ args ] ) ;
member = ';' | 'static' block | { decorator } cmods ( [ 'async' ] [ '*' ] ckey opt method0 | ( 'get' | 'set' ) ckey method0 | ckey opt bang ann [ '=' assign ] eos ) | tsmember ;
ckey = key | PRIVATE ;
method0 = tparams '(' [ params ] ')' ret fbody ;
import = 'import' STRING with eos | 'import' typeonly clause 'from' STRING with eos | tsimport ;
with = [ 'with' object ] ;
clause = ID [ ',' ( '*' 'as' ID | specs ) ] | '*' 'as' ID | specs ;
specs = '{' [ spec { ',' spec } [ ',' ] ] '}' ;
spec = typeonly ( NAME | STRING ) [ 'as' ( NAME | STRING ) ] ;
export = 'export' ( var eos | function | class | 'default' ( functionexpr | abstract classexpr | assign eos | tsdefault ) | '*' [ 'as' ( NAME | STRING ) ] 'from' STRING with eos
       | typeonly specs [ 'from' STRING with ] eos | tsexport ) | { decorator } 'export' ( class | 'default' abstract classexpr ) ;
"""

JAVASCRIPT = _ECMA + r"""
ann = ; ret = ; opt = ; bang = ; tparams = ; targs = ; implements = ; modifiers = ; abstract = ; typeonly = ;
cmods = [ 'static' ] ;
fbody = block ;
astype = NEVER ; cast = NEVER ; tssuffix = NEVER ; tsthis = NEVER ; tsstmt = NEVER ; tsmember = NEVER ; tsimport = NEVER ; tsexport = NEVER ; tsdefault = NEVER ;
"""

TYPESCRIPT = _ECMA + r"""
ann = [ ':' type ] ;
ret = [ ':' type ] ;
opt = [ '?' ] ;
bang = [ '!' ] ;
tparams = [ '<' tparam { ',' tparam } [ ',' ] '>' ] ;
tparam = { 'const' | 'in' | 'out' } ID [ 'extends' type ] [ '=' type ] ;
targs = [ targlist ] ;
targlist = '<' type { ',' type } [ ',' ] '>' ;
implements = [ 'implements' type { ',' type } ] ;
modifiers = { 'public' | 'private' | 'protected' | 'readonly' | 'override' } ;
abstract = [ 'abstract' ] ;
typeonly = [ 'type' ] ;
cmods = { 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' } ;
fbody = block | eos ;
astype = ( 'as' | 'satisfies' ) ( type | 'const' ) ;
cast = '<' type '>' ;
tssuffix = '!' | targlist ;
tsthis = 'this' ;
tsmember = cmods index eos ;
tsimport = 'import' [ 'type' ] ID '=' ( 'require' '(' STRING ')' | ID { '.' NAME } ) eos ;
tsexport = tsstmt | '=' expr eos | 'as' 'namespace' ID eos | 'import' ID '=' ID { '.' NAME } eos ;
tsdefault = interface ;
tsstmt = interface | 'type' ID tparams '=' type eos | [ 'const' ] enum | ( 'namespace' | 'module' ) ( ID { '.' ID } | STRING ) nsbody
       | 'declare' ( var eos | function | class | tsstmt | 'global' nsbody | 'module' STRING eos ) ;
nsbody = '{' { item } '}' ;
interface = 'interface' ID tparams [ 'extends' type { ',' type } ] objtype ;
enum = 'enum' ID '{' [ enumitem { ',' enumitem } [ ',' ] ] '}' ;
enumitem = ( NAME | STRING ) [ '=' assign ] ;
type = ID 'is' type | 'this' 'is' type | 'asserts' ( ID | 'this' ) [ 'is' type ] | fntype | uniontype [ 'extends' uniontype '?' type ':' type ] ;
fntype = [ 'abstract' ] [ 'new' ] tparams '(' [ params ] ')' '=>' type ;
uniontype = [ '|' | '&' ] ptype { ( '|' | '&' ) ptype } ;
ptype = { 'keyof' | 'readonly' | 'unique' } atype { '[' [ type ] ']' } | 'infer' ID [ 'extends' ptype ] ;
atype = 'typeof' ( ID | 'this' | 'import' '(' STRING ')' ) { '.' NAME } targs | ID { '.' NAME } targs | 'import' '(' STRING ')' { '.' NAME } targs
      | 'this' | 'null' | 'void' | 'true' | 'false' | STRING | NUMBER | '-' NUMBER | TEMPLATE | THEAD type { TMIDDLE type } TTAIL
      | objtype | '[' [ tupitem { ',' tupitem } [ ',' ] ] ']' | '(' type ')' ;
tupitem = [ '...' ] ( type [ '?' ] | NAME [ '?' ] ':' type ) ;
objtype = '{' { ',' | ';' | ASI | tmember ( ';' | ',' | ASI ) } [ tmember ] '}' ;
tmember = [ 'new' ] tparams '(' [ params ] ')' ret | [ 'readonly' ] key [ '?' ] ann | key [ '?' ] tparams '(' [ params ] ')' ret
        | ( 'get' | 'set' ) key '(' [ params ] ')' ret | [ [ '+' | '-' ] 'readonly' ] mapped | [ 'readonly' ] index ;
index = '[' ID ':' type ']' ':' type ;
mapped = '[' ID 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] [ ':' type ] ;
"""

_GO_EXPR = r"""
expr@ = unary@ { BINOP unary@ | '*' unary@ | '|' unary@ } ;
unary@ = { '+' | '-' | '!' | '^' | '*' | '&' | '<-' } primary@ ;
primary@ = ( ID | NUMBER | STRING | CHAR | 'func' sig block | '(' ( expr | type ) ')' | littype ( '{' [ elems ] '}' | '(' expr [ ',' ] ')' ) | 'chan' type | 'interface' '{' ielems '}' '(' expr ')' ) { suffix@ } ;
exprs@ = expr@ { ',' expr@ } ;
simple@ = exprs@ [ ( '=' | ':=' | ASSIGN ) exprs@ | '++' | '--' | '<-' expr@ ] ;
suffix@ = '.' ( ID | '(' ( type | 'type' ) ')' ) | '[' index ']' | '(' [ args ] ')' LITERAL@ ;
"""

GO = (
    r"""
file = 'package' ID ';' { import ';' } { top ';' } END ;
import = 'import' ( ispec | '(' [ ispec { ';' ispec } [ ';' ] ] ')' ) ;
ispec = [ ID | '.' ] STRING ;
top = const | var | types | 'func' [ '(' [ params ] ')' ] ID [ tparams ] sig [ block ] ;
const = 'const' ( cspec | '(' [ cspec { ';' cspec } [ ';' ] ] ')' ) ;
cspec = ids [ [ type ] '=' exprs ] ;
var = 'var' ( vspec | '(' [ vspec { ';' vspec } [ ';' ] ] ')' ) ;
vspec = ids ( type [ '=' exprs ] | '=' exprs ) ;
types = 'type' ( tspec | '(' [ tspec { ';' tspec } [ ';' ] ] ')' ) ;
tspec = ID [ tparams ] [ '=' ] type ;
ids = ID { ',' ID } ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = ids constraint ;
constraint = [ '~' ] type { '|' [ '~' ] type } ;
sig = '(' [ params ] ')' [ '(' [ params ] ')' | type ] ;
params = param { ',' param } [ ',' ] ;
param = [ ID ] [ '...' ] type ;
type = ID [ '.' ID ] [ '[' type { ',' type } ']' ] | '*' type | littype | [ '<-' ] 'chan' [ '<-' ] type | 'func' sig | 'interface' '{' ielems '}' | '(' type ')' ;
littype = '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' ;
field = ids type [ STRING ] | [ '*' ] ID [ '.' ID ] [ '[' type { ',' type } ']' ] [ STRING ] ;
ielems = [ ielem { ';' ielem } [ ';' ] ] ;
ielem = ID sig | constraint ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = const | var | types | ID ':' [ stmt ] | simple | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ ID ] | 'continue' [ ID ]
     | 'goto' ID | 'fallthrough' | block | if | switch | 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' | for ;
if = 'if' [ [ simplen ] ';' ] simplen block [ 'else' ( if | block ) ] ;
switch = 'switch' [ [ simplen ] ';' ] [ simplen ] '{' { ( 'case' case { ',' case } | 'default' ) ':' stmts } '}' ;
case = expr | type ;
for = 'for' [ exprn | [ simplen ] ';' [ exprn ] ';' [ simplen ] | [ exprsn ( '=' | ':=' ) ] 'range' exprn ] block ;
elems = elem { ',' elem } [ ',' ] ;
elem = value [ ':' value ] ;
value = expr | '{' [ elems ] '}' ;
args = arg { ',' arg } [ '...' ] [ ',' ] ;
arg = expr | type ;
index = ( expr | type ) { ',' ( expr | type ) } [ ',' ] | [ expr ] ':' [ expr ] [ ':' expr ] ;
"""
    + _GO_EXPR.replace("LITERAL@", "| '{' [ elems ] '}'").replace("@", "")
    + _GO_EXPR.replace("LITERAL@", "").replace("@", "n")
)

_RUST_EXPR = r"""
expr@ = chain@ [ RANGE [ chain@ ] ] | RANGE [ chain@ ] ;
chain@ = operand@ { binop operand@ | 'as' type } ;
operand@ = { '-' | '!' | '*' | ( '&' | '&&' ) [ 'mut' | 'raw' ( 'const' | 'mut' ) ] } primary@ | closure@ | 'return' [ expr@ ] | 'break' [ LIFE ] [ expr@ ] | 'continue' [ LIFE ] ;
closure@ = { 'move' | 'async' | 'static' } ( '||' | '|' [ cparam { ',' cparam } [ ',' ] ] '|' ) ( expr@ | '->' type block ) ;
primary@ = atom@ { '.' ( ID [ '::' gargs ] | NUMBER | 'await' ) | '(' [ exprs ] ')' | '[' expr ']' | '?' } ;
atom@ = literal | pathexpr STRUCT@ | macro | '(' [ exprs ] ')' | '[' [ expr ( ';' expr | { ',' expr } [ ',' ] ) ] ']' | exprblock ;
"""

RUST = (
    r"""
file = { '#' '!' tt } items END ;
items = { item } ;
item = { '#' tt } [ vis ] ( fn | struct | enum | impl | trait | 'mod' ID ( ';' | '{' { '#' '!' tt } items '}' ) | 'use' usetree ';'
     | 'const' ( ID | '_' ) ':' type [ '=' expr ] ';' | 'static' [ 'mut' ] ID ':' type [ '=' expr ] ';'
     | 'type' ID [ gparams ] [ ':' bounds ] [ where ] [ '=' type ] [ where ] ';' | 'extern' 'crate' ( ID | 'self' ) [ 'as' ID ] ';'
     | [ 'unsafe' ] 'extern' [ STRING ] '{' items '}' | macroitem ) ;
macroitem = simplepath '!' [ ID ] ( '{' { ttok } '}' | ( '(' { ttok } ')' | '[' { ttok } ']' ) ';' ) ;
simplepath = [ '::' ] seg { '::' seg } ;
seg = ID | 'self' | 'Self' | 'super' | 'crate' ;
vis = 'pub' [ '(' ( 'crate' | 'self' | 'super' | 'in' simplepath ) ')' ] ;
fn = { 'const' | 'async' | 'unsafe' | 'extern' [ STRING ] } 'fn' ID [ gparams ] '(' [ fparam { ',' fparam } [ ',' ] ] ')' [ '->' type ] [ where ] ( block | ';' ) ;
fparam = { '#' tt } ( [ '&' [ LIFE ] ] [ 'mut' ] 'self' [ ':' type ] | pat ':' type | '...' ) ;
gparams = '<' [ gparam { ',' gparam } [ ',' ] ] '>' ;
gparam = { '#' tt } ( LIFE [ ':' [ LIFE { '+' LIFE } ] ] | ID [ ':' bounds ] [ '=' type ] | 'const' ID ':' type [ '=' ( literal | block | ID ) ] ) ;
bounds = [ bound { '+' bound } [ '+' ] ] ;
bound = LIFE | [ '?' ] [ 'for' gparams ] typepath | '(' bound ')' ;
where = 'where' [ wpred { ',' wpred } [ ',' ] ] ;
wpred = LIFE ':' bounds | [ 'for' gparams ] type ':' bounds ;
struct = ( 'struct' | 'union' ) ID [ gparams ] ( [ where ] '{' fields '}' | '(' tfields ')' [ where ] ';' | [ where ] ';' ) ;
fields = [ field { ',' field } [ ',' ] ] ;
field = { '#' tt } [ vis ] ID ':' type ;
tfields = [ tfield { ',' tfield } [ ',' ] ] ;
tfield = { '#' tt } [ vis ] type ;
enum = 'enum' ID [ gparams ] [ where ] '{' [ variant { ',' variant } [ ',' ] ] '}' ;
variant = { '#' tt } [ vis ] ID [ '{' fields '}' | '(' tfields ')' ] [ '=' expr ] ;
impl = [ 'unsafe' ] 'impl' [ gparams ] [ 'const' ] [ '!' ] type [ 'for' type ] [ where ] '{' { '#' '!' tt } items '}' ;
trait = { 'unsafe' | 'auto' } 'trait' ID [ gparams ] [ ':' bounds ] [ where ] '{' { '#' '!' tt } items '}' ;
usetree = [ '::' ] { seg '::' } ( '*' | '{' [ usetree { ',' usetree } [ ',' ] ] '}' | seg [ 'as' ( ID | '_' ) ] ) ;
type = '(' [ type { ',' type } [ ',' ] ] ')' | '!' | ( '&' | '&&' ) [ LIFE ] [ 'mut' ] type | '*' ( 'const' | 'mut' ) type | '[' type [ ';' expr ] ']'
     | [ 'for' gparams ] { 'unsafe' | 'extern' [ STRING ] } 'fn' '(' [ fnarg { ',' fnarg } [ ',' ] ] ')' [ '->' type ]
     | 'impl' bounds | 'dyn' bounds | '_' | typepath | simplepath '!' tt ;
fnarg = [ ( ID | '_' ) ':' ] type | '...' ;
typepath = ( [ '::' ] tseg | '<' type [ 'as' typepath ] '>' '::' tseg ) { '::' tseg } ;
tseg = seg [ [ '::' ] gargs | '(' [ type { ',' type } [ ',' ] ] ')' [ '->' type ] ] ;
gargs = '<' [ garg { ',' garg } [ ',' ] ] '>' ;
garg = LIFE | type | ID [ gargs ] '=' type | ID ':' bounds | [ '-' ] literal | block ;
pat = [ '|' ] p1 { '|' p1 } ;
p1 = '_' | RANGE [ plit ] | plit [ ( RANGE | '...' ) [ plit ] ] | { 'ref' | 'mut' } ID [ '@' p1 ] | ( '&' | '&&' ) [ 'mut' ] p1
   | '(' [ pat { ',' pat } [ ',' ] ] ')' | '[' [ pat { ',' pat } [ ',' ] ] ']'
   | pathexpr [ '(' [ pat { ',' pat } [ ',' ] ] ')' | '{' [ fpat { ',' fpat } [ ',' ] ] '}' | ( RANGE | '...' ) [ plit ] ] | simplepath '!' tt ;
plit = [ '-' ] literal | pathexpr ;
fpat = { '#' tt } ( ( ID | NUMBER ) ':' pat | { 'ref' | 'mut' } ID | RANGE ) ;
literal = NUMBER | STRING | CHAR | 'true' | 'false' ;
block = '{' { '#' '!' tt } { stmt } [ { '#' tt } expr ] '}' ;
stmt = ';' | item | { '#' tt } ( 'let' pat [ ':' type ] [ '=' expr [ 'else' block ] ] ';' | exprblock | expr ';' ) | simplepath '!' '{' { ttok } '}' ;
exprblock = [ LIFE ':' ] ( if | 'while' cond block | 'loop' block | 'for' pat 'in' exprn block | block ) | match | { 'unsafe' | 'async' | 'move' | 'const' } block ;
if = 'if' cond block [ 'else' ( if | block ) ] ;
cond = 'let' pat '=' exprn | exprn ;
match = 'match' exprn '{' { '#' '!' tt } { arm ( expr ',' | exprblock [ ',' ] ) } [ arm expr ] '}' ;
arm = { '#' tt } pat [ 'if' ( 'let' pat '=' expr | expr ) ] '=>' ;
binop = BINOP | '<' | '>' [ '>' ] [ '=' ] | '=' | '*' | '-' | '&' | '&&' | '||' | '|' | '+' ;
cparam = pat [ ':' type ] ;
exprs = { '#' tt } expr { ',' expr } [ ',' ] ;
pathexpr = ( [ '::' ] pseg | '<' type [ 'as' typepath ] '>' '::' pseg ) { '::' pseg } ;
pseg = seg [ '::' gargs ] ;
structlit = '{' [ sfield { ',' sfield } ] [ ',' ] [ RANGE expr ] '}' ;
sfield = { '#' tt } ( ID | NUMBER ) [ ':' expr ] ;
macro = simplepath '!' tt ;
tt = '(' { ttok } ')' | '[' { ttok } ']' | '{' { ttok } '}' ;
ttok = tt | ANY ;
"""
    + _RUST_EXPR.replace("STRUCT@", "[ structlit ]").replace("@", "")
    + _RUST_EXPR.replace("STRUCT@", "").replace("@", "n")
)

START = {"python": "file", "javascript": "module", "typescript": "module", "go": "file", "rust": "file"}
TEXT = {"python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST}
