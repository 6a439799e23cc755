"""Grammars of go, java, javascript, c and rust for codelens.llm.peg.

They take the languages' syntax as it is written down by their makers, in an order fit for
ordered choice. Precedence of operators is left out: it changes what an expression means, not
whether it is one."""

from __future__ import annotations

import sys
from functools import cache

from codelens.llm.peg import Grammar
from codelens.llm.source import tokens

RESERVED = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false let",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Noreturn _Static_assert _Alignas _Alignof _Thread_local _Atomic",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while true false",
}

GO = r"""
file = 'package' ID end (import end)* (top end)* EOF0 ;
EOF0_ = ID ;
end = ';'+ / &')' / &'}' / &EOF ;
import = 'import' (spec / '(' (spec end)* ')') ;
spec = ('.' / ID)? STR ;
top = func / 'func' ID typeparams? signature / decl ;
func := 'func' params? @ID typeparams? signature block ;
decl = 'const' (constspec / '(' (constspec end)* ')') / 'var' (varspec / '(' (varspec end)* ')') / 'type' (typespec / '(' (typespec end)* ')') ;
ids = ID (',' ID)* ;
constspec = ids (type? '=' exprs)? ;
varspec = ids (type ('=' exprs)? / '=' exprs) ;
typespec = ID typeparams '='? type / ID '='? type ;
typeparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ids union ;
signature = params (params / type)? ;
params = '(' (param (',' param)* ','?)? ')' ;
param = ID '...'? type / '...'? type ;
type = typename / '*' type / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / '<-' 'chan' type / 'chan' '<-'? type / 'func' signature / struct / interface / '(' type ')' ;
typename = ID ('.' ID)? typeargs? ;
typeargs = '[' type (',' type)* ','? ']' ;
struct = 'struct' '{' (field end)* '}' ;
field = (ids type / '*'? typename) STR? ;
interface = 'interface' '{' (elem end)* '}' ;
elem = ID signature / union ;
union = '~'? type ('|' '~'? type)* ;
block = '{' stmts '}' ;
stmts = (stmt? ';')* stmt? ;
stmt = decl / ID ':' !'=' stmt? / ('go' / 'defer') expr / 'return' exprs? / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough' / block / if / switch / select / for / simple ;
simple = exprs ((':=' / assign) exprs / '++' / '--' / '<-' expr)? ;
nsimple = nexprs ((':=' / assign) nexprs / '++' / '--' / '<-' nexpr)? ;
assign = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=' ;
if = 'if' (nsimple? ';')? nexpr block ('else' (if / block))? ;
switch = 'switch' (nsimple? ';')? nsimple? '{' (('case' cases / 'default') ':' stmts)* '}' ;
cases = case (',' case)* ;
case = expr / type ;
select = 'select' '{' (('case' simple / 'default') ':' stmts)* '}' ;
for = 'for' (range / nsimple? ';' nexpr? ';' nsimple? / nexpr)? block ;
range = (nexprs (':=' / '='))? 'range' nexpr ;
exprs = expr (',' expr)* ;
nexprs = nexpr (',' nexpr)* ;
expr = unary (binary unary)* ;
nexpr = nunary (binary nunary)* ;
binary = '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<<' / '>>' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '&&' / '||' ;
prefix = '+' / '-' / '!' / '^' / '*' / '&' / '<-' ;
unary = prefix* (composite / operand) postfix* ;
nunary = prefix* (typelit values / operand) postfix* ;
composite = (typename / typelit) values ;
typelit = '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / struct / interface / 'chan' '<-'? type / '<-' 'chan' type ;
values = '{' (keyed (',' keyed)* ','?)? '}' ;
keyed = value (':' value)? ;
value = values / expr ;
operand = STR / NUM / 'func' signature block / ID / '(' (expr / type) ')' / typelit / 'func' signature ;
postfix = '.' ID / '.' '(' (type / 'type') ')' / '[' (expr? ':' expr? (':' expr)? / case (',' case)* ','?) ']' / '(' (case (',' case)* '...'? ','?)? ')' ;
"""
GO = GO.replace("EOF0_ = ID ;\n", "").replace(" EOF0 ;", " &EOF ;")

JAVA = r"""
file = (annotation* 'package' qname ';')? (import / ';')* (typedecl / ';')* &EOF ;
import = 'import' 'static'? qname ('.' '*')? ';' ;
qname = ID ('.' ID)* ;
mods = (annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' / "sealed" / "non" '-' "sealed")* ;
annotation = '@' qname ('(' (pair (',' pair)* ','? / avalue)? ')')? ;
pair = ID '=' avalue ;
avalue = annotation / '{' (avalue (',' avalue)*)? ','? '}' / expr ;
typedecl = mods (class / interface / enum / record / '@' 'interface' ID classbody) ;
class = 'class' ID typarams? ('extends' type)? ('implements' types)? ("permits" types)? classbody ;
interface = 'interface' ID typarams? ('extends' types)? ("permits" types)? classbody ;
record = "record" ID typarams? '(' params? ')' ('implements' types)? classbody ;
enum = 'enum' ID ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}' ;
constant = annotation* ID args? classbody? ;
classbody = '{' member* '}' ;
member = ';' / 'static'? block / method / ctor / typedecl / mods typarams? type ID '(' params? ')' dims throws? ('default' avalue)? ';' / mods type declarators ';' / mods ID block ;
method := mods typarams? annotation* type @ID '(' params? ')' dims throws? block ;
ctor := mods typarams? @ID '(' params? ')' throws? block ;
throws = 'throws' types ;
types = type (',' type)* ;
declarators = declarator (',' declarator)* ;
declarator = ID dims ('=' init)? ;
init = '{' (init (',' init)*)? ','? '}' / expr ;
dims = (annotation* '[' ']')* ;
type = annotation* (primitive / 'void' / classtype) dims ;
primitive = 'boolean' / 'byte' / 'char' / 'double' / 'float' / 'int' / 'long' / 'short' ;
classtype = ID typargs? ('.' annotation* ID typargs?)* ;
typargs = '<' (typarg (',' typarg)*)? '>' ;
typarg = annotation* '?' (('extends' / 'super') type)? / type ;
typarams = '<' typaram (',' typaram)* '>' ;
typaram = annotation* ID ('extends' type ('&' type)*)? ;
params = param (',' param)* ;
param = mods type '...'? (ID dims / 'this') ;
block = '{' stmt* '}' ;
stmt = block / ';' / 'if' paren stmt ('else' stmt)? / 'while' paren stmt / 'do' stmt 'while' paren ';' / for / switch / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') ID? ';' / try / 'synchronized' paren block / 'assert' expr (':' expr)? ';' / "yield" expr ';' / ID ':' stmt / local ';' / mods (class / interface / enum / record) / expr ';' ;
paren = '(' expr ')' ;
local = mods type declarators ;
for = 'for' '(' (mods type ID dims ':' expr / (local / exprs)? ';' expr? ';' exprs?) ')' stmt ;
exprs = expr (',' expr)* ;
switch = 'switch' paren '{' ((('case' labels / 'default') ':')+ stmt* / ('case' labels / 'default') '->' (block / 'throw' expr ';' / expr ';'))* '}' ;
labels = label (',' label)* (ID expr)? ;
label = 'default' / mods type ID &('->' / ':' / ',' / ID) / unary (binary unary)* ;
try = 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' mods type ('|' type)* ID ')' block)* ('finally' block)? ;
resource = mods type ID '=' expr / expr ;
expr = lambda / unary (binary unary / 'instanceof' ('final'? type ID? / type) / '?' expr ':' expr / assign expr)* ;
assign = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>=' ;
binary = '>' '>' '>' / '>' '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<<' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '&&' / '||' ;
lambda = (ID / '(' (ID (',' ID)*)? ')' / '(' params? ')') '->' (block / expr) ;
unary = ('+' / '-' / '!' / '~' / '++' / '--')* (cast / primary postfix*) ;
cast = '(' primitive dims ')' unary / '(' type ('&' type)* ')' &(ID / STR / NUM / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'switch' / 'true' / 'false' / 'null' / primitive) (lambda / unary) ;
primary = STR / NUM / 'true' / 'false' / 'null' / 'this' / 'super' / 'new' creator / switch / '(' expr ')' / (primitive / 'void') dims ('.' 'class' / '::' 'new') / classtype dims '::' (ID / 'new') / ID ('[' ']')+ '.' 'class' / ID ;
creator = annotation* typargs? (primitive / classtype) (('[' expr ']')+ dims / dims init / args classbody?) ;
args = '(' (expr (',' expr)*)? ')' ;
postfix = '.' (typargs? ID / 'new' creator / 'this' / 'class' / 'super') / args / '[' expr ']' / '++' / '--' / '::' typargs? (ID / 'new') ;
"""

JAVASCRIPT = r"""
file = stmt* &EOF ;
eos = ';' / &'}' / &EOF / NL ;
stmt = block / ';' / function / class / var eos / 'if' paren stmt ('else' stmt)? / for / 'while' paren stmt / 'do' stmt 'while' paren ';'? / 'return' (!NL expr)? eos / ('break' / 'continue') (!NL ID)? eos / 'throw' expr eos / try / switch / import / export / 'debugger' eos / 'with' paren stmt / ID ':' stmt / expr eos ;
block = '{' stmt* '}' ;
paren = '(' expr ')' ;
function := "async"? 'function' '*'? @ID params block ;
class = 'class' (!'extends' ID)? ('extends' unary)? '{' (';' / accessor / method / member)* '}' ;
method := "static"? ("async" !NL)? '*'? '#'? @ID params block ;
accessor := "static"? ("get" / "set") '#'? @ID params block ;
member = "static"? ("async" !NL)? ('*' / ("get" / "set") &propname)? propname params block / "static" block / "static"? propname ('=' assign)? eos ;
propname = '#'? (ID / word) / STR / NUM / '[' assign ']' ;
word = 'break' / 'case' / 'catch' / 'class' / 'const' / 'continue' / 'default' / 'delete' / 'do' / 'else' / 'export' / 'extends' / 'finally' / 'for' / 'function' / 'if' / 'import' / 'in' / 'instanceof' / 'new' / 'return' / 'super' / 'switch' / 'this' / 'throw' / 'try' / 'typeof' / 'var' / 'void' / 'while' / 'with' / 'null' / 'true' / 'false' / 'let' / 'debugger' ;
params = '(' (bindings ','?)? ')' ;
bindings = ('...' target / target ('=' assign)?) (',' ('...' target / target ('=' assign)?))* ;
target = ID / '[' (','* element)* ','* ']' / '{' (property (',' property)* ','?)? '}' ;
element = '...' target / target ('=' assign)? ;
property = '...' ID / propname ':' target ('=' assign)? / ID ('=' assign)? ;
var = ('const' / 'let' / 'var') declared (',' declared)* ;
declared = named / target ('=' assign)? ;
named := @ID '=' (arrow / "async"? 'function' '*'? ID? params block) &(eos / ',') ;
for = 'for' "await"? '(' (('const' / 'let' / 'var') target ("of" / 'in') expr / unary ("of" / 'in') expr / (var / expr)? ';' expr? ';' expr?) ')' stmt ;
try = 'try' block ('catch' ('(' target ')')? block)? ('finally' block)? ;
switch = 'switch' paren '{' (('case' expr / 'default') ':' stmt*)* '}' ;
import = 'import' (STR / imported "from" STR) eos ;
imported = ID (',' (names / '*' "as" ID))? / names / '*' "as" ID ;
names = '{' (alias (',' alias)* ','?)? '}' ;
alias = (ID / word / STR) ("as" (ID / word / STR))? ;
export = 'export' ('default' (function / class / assign eos) / names ("from" STR)? eos / '*' ("as" ID)? "from" STR eos / function / class / var eos) ;
expr = assign (',' assign)* ;
assign = arrow / "yield" '*'? (!NL assign)? / unary (binary unary / '?' assign ':' assign / set assign)* ;
set = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' ;
binary = '+' / '-' / '*' / '/' / '%' / '**' / '&' / '|' / '^' / '<<' / '>>' / '>>>' / '==' / '!=' / '===' / '!==' / '<' / '<=' / '>' / '>=' / '&&' / '||' / '??' / 'in' / 'instanceof' ;
arrow = ("async" !NL)? (ID / params) !NL '=>' (block / assign) ;
unary = ('+' / '-' / '!' / '~' / '++' / '--' / 'typeof' / 'void' / 'delete' / "await" &operand)* primary postfix* (!NL ('++' / '--'))? ;
operand = ID / 'this' / 'new' / 'import' / '(' / '[' / '{' / STR / TEMPLATE / 'function' / 'super' ;
primary = STR / TEMPLATE / NUM / REGEX / "async"? 'function' '*'? ID? params block / class / 'new' ('.' ID / primary (!args postfix)* args?) / 'import' ('.' ID / args) / 'this' / 'super' / 'null' / 'true' / 'false' / array / object / paren / '#' ID / ID ;
array = '[' (','* ('...' assign / assign))? (','+ ('...' assign / assign))* ','* ']' ;
object = '{' (entry (',' entry)* ','?)? '}' ;
omethod := ("async" !NL)? '*'? @ID params block ;
entry = '...' assign / propname ':' assign / omethod / ("async" !NL)? ('*' / ("get" / "set") &propname)? propname params block / ID ('=' assign)? ;
args = '(' (('...' assign / assign) (',' ('...' assign / assign))* ','?)? ')' ;
postfix = '.' '#'? (ID / word) / '?.' ('#'? (ID / word) / args / '[' expr ']') / '[' expr ']' / args / TEMPLATE ;
"""

C = r"""
file = external* &EOF ;
external = ';' / function / 'extern' STR '{' external* '}' / decl / ID '(' tree* ')' ';'? / ID &('typedef' / 'struct' / 'static' / 'extern' / 'enum') ;
tree = '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / ANY ;
function := specs ('*' qualifier*)* attribute? @ID '(' params? ')' attribute* block ;
attribute = ("__attribute__" / "__declspec" / '_Alignas' / "__asm__") '(' tree* ')' / '[' '[' tree* ']' ']' ;
qualifier = 'const' / 'volatile' / 'restrict' / '_Atomic' / 'static' / 'extern' / 'inline' / 'register' / 'auto' / 'typedef' / '_Noreturn' / '_Thread_local' / attribute ;
specs = qualifier* (tagged / builtin (qualifier / builtin)* / ID) qualifier* ;
builtin = 'void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / '_Bool' ;
tagged = ('struct' / 'union') attribute* (ID ('{' member* '}')? / '{' member* '}') / 'enum' (ID ('{' enumerators '}')? / '{' enumerators '}') ;
member = specs (mdeclarator (',' mdeclarator)*)? ';' / ';' / '_Static_assert' '(' tree* ')' ';' ;
mdeclarator = declarator? ':' assign / declarator ;
enumerators = ID ('=' assign)? (',' ID ('=' assign)?)* ','? ;
decl = '_Static_assert' '(' tree* ')' ';' / specs (initial (',' initial)*)? ';' ;
initial = declarator attribute* ('=' init)? ;
declarator = ('*' qualifier*)* (attribute? ID / '(' declarator ')') suffix* ;
suffix = '[' 'static'? qualifier* assign? ']' / '(' params? ')' ;
params = param (',' param)* (',' '...')? ;
param = specs (declarator / abstract)? ;
abstract = ('*' qualifier*)+ aparen* / aparen+ ;
aparen = '(' abstract ')' / '[' assign? ']' / '(' params? ')' ;
typename = specs abstract? ;
init = '{' (designated (',' designated)* ','?)? '}' / assign ;
designated = (('.' ID / '[' assign ('...' assign)? ']')+ '=')? init ;
block = '{' stmt* '}' ;
stmt = block / ';' / 'if' paren stmt ('else' stmt)? / 'while' paren stmt / 'do' stmt 'while' paren ';' / 'for' '(' (decl / expr? ';') expr? ';' expr? ')' stmt / 'switch' paren stmt / 'case' assign ('...' assign)? ':' / 'default' ':' / 'return' (init / expr)? ';' / 'goto' '*'? ID ';' / ('break' / 'continue') ';' / ID ':' / "asm" 'volatile'? '(' tree* ')' ';' / decl / expr ';' ;
paren = '(' expr ')' ;
expr = assign (',' assign)* ;
assign = unary (binary unary / '?' expr? ':' assign / set assign)* ;
set = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '<<=' / '>>=' / '&=' / '|=' / '^=' ;
binary = '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<<' / '>>' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '&&' / '||' ;
unary = ('+' / '-' / '!' / '~' / '*' / '&' / '&&' / '++' / '--')* (('sizeof' / '_Alignof') ('(' typename ')' !'{' / unary) / cast / primary postfix*) ;
cast = '(' typename ')' ('{' (designated (',' designated)* ','?)? '}' postfix* / unary) ;
primary = STR+ / STR / NUM / ID / '(' block ')' / paren ;
postfix = '[' expr ']' / '(' ((assign / typename) (',' (assign / typename))*)? ')' / '.' ID / '->' ID / '++' / '--' ;
"""

RUST = r"""
file = inner* item* &EOF ;
inner = '#' '!' '[' tree* ']' ;
attr = '#' '[' tree* ']' ;
tree = '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / ANY ;
group = '(' tree* ')' / '[' tree* ']' / '{' tree* '}' ;
vis = 'pub' ('(' ('crate' / 'super' / 'self' / 'in' path) ')')? ;
item = ';' / fn / attr* vis? (use / 'const' (ID / "_") ':' type ('=' expr)? ';' / 'static' 'mut'? ID ':' type ('=' expr)? ';' / fnhead ';' / struct / enum / impl / trait / 'unsafe'? 'mod' ID (';' / '{' inner* item* '}') / 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';' / 'unsafe'? 'extern' (STR? '{' inner* item* '}' / 'crate' ID ('as' ID)? ';') / "macro_rules" '!' ID group ';'? / path '!' ID? ('{' tree* '}' / group ';')) ;
fnhead = ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' ID generics? '(' params? ')' ('->' type)? where? ;
fn := attr* vis? ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' @ID generics? '(' params? ')' ('->' type)? where? block ;
params = param (',' param)* ','? ;
param = attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' type)? / pattern ':' type / '...') ;
use = 'use' usetree ';' ;
usetree = '::'? (('crate' / 'self' / 'super' / ID) ('::' ('crate' / 'self' / 'super' / ID))* ('::' ('*' / usegroup) / 'as' (ID / "_"))? / '*' / usegroup) ;
usegroup = '{' (usetree (',' usetree)* ','?)? '}' ;
struct = ('struct' / "union") ID generics? (where? '{' (field (',' field)* ','?)? '}' / '(' (tfield (',' tfield)* ','?)? ')' where? ';' / where? ';') ;
field = attr* vis? ID ':' type ;
tfield = attr* vis? type ;
enum = 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant = attr* vis? ID ('{' (field (',' field)* ','?)? '}' / '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)? ;
impl = 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' inner* item* '}' ;
trait = 'unsafe'? "auto"? 'trait' ID generics? (':' bounds?)? where? '{' inner* item* '}' ;
generics = '<' (gparam (',' gparam)* ','?)? '>' ;
gparam = attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' ID ':' type ('=' unary)? / ID (':' bounds?)? ('=' type)?) ;
where = 'where' (wpred (',' wpred)* ','?)? ;
wpred = LIFE ':' LIFE ('+' LIFE)* / forlife? type ':' bounds? ;
forlife = 'for' generics ;
bounds = bound ('+' bound)* '+'? ;
bound = LIFE / '(' bound ')' / '?'? forlife? path ;
type = '&&'? '&' LIFE? 'mut'? type / '&&' LIFE? 'mut'? type / '*' ('const' / 'mut') type / '[' type (';' expr)? ']' / '(' (type (',' type)* ','?)? ')' / ('dyn' / 'impl') bounds / forlife? ('unsafe' / 'extern' STR?)* 'fn' '(' (((ID / "_") ':')? type (',' ((ID / "_") ':')? type)* ','?)? ')' ('->' type)? / '!' / "_" / qpath / path '!' group / path ;
qpath = '<' type ('as' path)? '>' ('::' segment)+ ;
path = '::'? segment ('::' segment)* ;
segment = name ('::'? gargs / '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
name = ID / 'crate' / 'self' / 'super' / 'Self' ;
gargs = '<' (garg (',' garg)* ','?)? '>' ;
garg = LIFE / ID gargs? ('=' type / ':' bounds) / type / '-'? NUM / STR / block ;
epath = '::'? name ('::' (name / gargs))* ;
block = '{' inner* stmt* (expr)? '}' ;
stmt = ';' / attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' / item / attr* blocklike !('.' / '?') / attr* epath '!' '{' tree* '}' !('.' / '?') / attr* expr ';' ;
blocklike = (LIFE ':')? (if / match / 'loop' block / 'while' cond block / 'for' pattern 'in' nexpr block / ('unsafe' / 'async' 'move'? / 'const')? block) ;
if = 'if' cond block ('else' (if / block))? ;
cond = clause ('&&' clause)* ;
clause = 'let' pattern '=' nlet / nexpr ;
nlet = nunary (lbinary nunary / 'as' type)* ;
lbinary = '+' / '-' / '*' / '/' / '%' / '^' / '|' / '&' / '<<' / '>' '>' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '..=' / '..' ;
match = 'match' nexpr '{' inner* (arm)* '}' ;
arm = attr* pattern ('if' cond2)? '=>' (blocklike !('.' / '?' / '(') ','? / expr (',' / &'}')) ;
cond2 = ('let' pattern '=' expr / expr) ;
pattern = '|'? pat ('|' pat)* ;
pat = '&&'? '&' 'mut'? pat / '&&' 'mut'? pat / 'ref'? 'mut'? ID ('@' pat)? !('::' / '(' / '{' / '!' / '..' / '..=' / '...') / "_" / '..=' lit / plain (('..=' / '..' / '...') lit?)? / '(' (pat0 (',' pat0)* ','?)? ')' / '[' (pat0 (',' pat0)* ','?)? ']' / epath '!' group / (qpath / epath) ('(' (pat0 (',' pat0)* ','?)? ')' / '{' (pfield (',' pfield)* ','?)? '}' / ('..=' / '..' / '...') lit?)? / '..' ;
pat0 = '..' / pattern ;
plain = '-'? NUM / STR / 'true' / 'false' ;
lit = plain / epath ;
pfield = attr* ('..' / (ID / NUM) ':' pattern / 'ref'? 'mut'? ID) ;
expr = unary (binary unary / 'as' type / rangeop unary? / assign expr)* / rangeop unary? ;
nexpr = nunary (binary nunary / 'as' type / rangeop nunary? / assign nexpr)* / rangeop nunary? ;
rangeop = '..=' / '..' ;
assign = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' ;
binary = '+' / '-' / '*' / '/' / '%' / '^' / '|' / '&&' / '||' / '&' / '<<' / '>' '>' / '==' / '!=' / '<=' / '>=' / '<' / '>' ;
prefix = '-' / '!' / '*' / ('&&' / '&') ("raw" ('const' / 'mut'))? 'mut'? ;
unary = prefix* (structlit / primary) postfix* ;
nunary = prefix* primary postfix* ;
structlit = (qpath / epath) '{' (sfield (',' sfield)* ','?)? '}' ;
sfield = attr* ('..' expr? / (ID / NUM) ':' expr / ID) ;
primary = STR / NUM / 'true' / 'false' / closure / 'return' expr? / 'break' LIFE? expr? / 'continue' LIFE? / blocklike / '(' (attr* expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / epath '!' group / qpath / epath / "_" ;
closure = ('static' / 'async' / 'move')* ('||' / '|' (cparam (',' cparam)* ','?)? '|') ('->' type block / expr) ;
cparam = attr* pat (':' type)? ;
postfix = '?' / '.' ('await' / name ('::' gargs)? / NUM) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']' ;
"""
SOURCES = {"go": GO, "java": JAVA, "javascript": JAVASCRIPT, "c": C, "rust": RUST}
LANGUAGES = tuple(SOURCES)
ENDS_GO = frozenset("ID STR NUM break continue fallthrough return ++ -- ) ] }".split())
KEYS = {"word": "ID", "string": "STR", "number": "NUM", "life": "LIFE", "regex": "REGEX"}


@cache
def grammar(language: str) -> Grammar:
    return Grammar(SOURCES[language])


@cache
def reserved(language: str) -> frozenset:
    return frozenset(RESERVED[language].split())


sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # calls of Python functions take no space on the stack of C


def with_ends(text: str, toks: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Tokens of a go file without comments, with the semicolons that stand for line ends."""
    code, ends, end = [], False, 0
    words = reserved("go")
    for x in toks:
        kind, t, at = x
        if ends and text.find("\n", end, at) >= 0:
            code.append(("sign", ";", at))
            ends = False
        if kind != "comment":
            code.append(x)
            end = at + len(t)
            ends = (t if kind == "sign" or kind == "word" and t in words else KEYS[kind]) in ENDS_GO
    if ends:
        code.append(("sign", ";", len(text)))
    return code


class Parsed:
    """A text as tokens, and what it defines if it is of the language."""

    def __init__(self, language: str, text: str, toks: list[tuple[str, str, int]] | None = None):
        toks = tokens(language, text) if toks is None else toks
        skip = text.find("\n") if language == "javascript" and text.startswith("#!") else -1
        if skip >= 0:
            toks = [x for x in toks if x[2] >= skip]
        self.notes = None
        self.bad = any(kind == "bad" for kind, _, _ in toks)
        if self.bad:
            return
        self.comments: list[tuple[int, str]] = [(at, t) for kind, t, at in toks if kind == "comment"]
        if language == "go":
            code = with_ends(text, toks)
        else:
            code = [x for x in toks if x[0] != "comment" and x[0] != "pre"]
            if language in ("java", "rust") and ">>" in text:
                code = [y for x in code for y in ([("sign", ">", x[2] + n) for n in range(len(x[1]))] if x[0] == "sign" and x[1] in (">>", ">>>") else (x,))]
        words = reserved(language)
        self.kinds = [t if kind == "sign" or kind == "word" and t in words else KEYS[kind] for kind, t, _ in code]
        self.texts = [t for _, t, _ in code]
        self.starts = [at for _, _, at in code]
        if language == "javascript" and "`" in text:
            self.kinds = ["TEMPLATE" if k == "STR" and t[0] == "`" else k for k, t in zip(self.kinds, self.texts)]
        # the others' grammars do not ask for line ends
        breaks = [text.find("\n", end, at) >= 0 for end, at in zip([0, *(at + len(t) for _, t, at in code)], self.starts)] if language == "javascript" else [False] * len(code)
        self.notes = grammar(language).parse(self.kinds, self.texts, breaks)

    @property
    def valid(self) -> bool:
        return self.notes is not None
