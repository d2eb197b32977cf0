"""Grammars over token classes, and the adjacent token pairs they permit.

A grammar is text: ``name: alternative | alternative``; a symbol of one character is a token class, a longer one a rule; a
symbol with ``*`` may be repeated or left out, with ``?`` left out, and ``rule%`` is one or more with commas between. ``pairs``
derives from FIRST and LAST sets which two classes may stand next to each other; ``automata`` reduces whole statements by the
same rules. The classes of each language are in ``lexing``; $ is the start and the end of a file. ; also is a line end that
ends a statement, b in Python an indented block. No rule may be left-recursive.
"""

from __future__ import annotations

from functools import cache

_PYTHON = """
file: $ stmt* $
name: i | m | k | t
stmt: line | comp
line: small more* N? ;
more: N small
small: stars | target ann | target ann = value | assign | target g value | R | R stars | r | r test | r test f test | B | U mod% | G name% | D target% | D target% , | q test | q test , test | imp | yield | t name tps? = test
ann: : test
assign: tlist = atail
atail: tlist = atail | value
value: stars | yield
yield: y | y stars | y f test
tlist: startgt% | startgt% ,
startgt: S target | target
target: name | atom post* tend | ( tlist ) | ( ) | [ tlist? ]
tend: . name | [ subs ]
mod: dotted | dotted A name
dotted: name dots*
dots: . name
imp: f origin U asname% | f origin U ( asname% ) | f origin U ( asname% , ) | f origin U S
origin: dot* dotted | dot dot*
dot: . | e
asname: name | name A name
comp: I named suite elif* else? | W named suite else? | forst | j forst | T suite except except* else? fin? | T suite fin | withst | j withst | m stars : b { case case* } | def | class | deco deco* def | deco deco* class
elif: E named suite
else: L suite
forst: F tlist Z stars suite else?
except: X suite | X test suite | X test A name suite | X S test suite | X S test A name suite
fin: Y suite
withst: H with1% suite | H ( with1% , ) suite | H ( with1% ) suite
with1: test | test A startgt
def: j? P name tps? ( params? ) ret? suite
ret: a test
class: K name tps? suite | K name tps? ( args? ) suite
deco: @ named ;
tps: [ tp% ] | [ tp% , ]
tp: name ann? | name ann? = test | S name | Q name
suite: : line | : b { stmt stmt* }
case: k pats guard? suite
guard: I named
pats: pat% | pat% ,
pat: orpat | orpat A name | S name
orpat: cpat orp*
orp: z cpat
cpat: u? n | u? n u n | c | strs | dotted | dotted ( ) | dotted ( cargs ) | ( ) | ( pats ) | [ ] | [ pats ] | { } | { dpat% } | { dpat% , }
cargs: carg% | carg% ,
carg: pat | name = pat
dpat: u? n : pat | c : pat | strs : pat | dotted : pat | Q name
params: pos | pos , | pos , star | star | pos , kwds | kwds
pos: plain% | dflt% | plain% , dflt% | plain% , / | plain% , / , plain% | plain% , / , dflt% | plain% , / , plain% , dflt% | plain% , dflt% , / | plain% , dflt% , / , dflt% | dflt% , / | dflt% , / , dflt%
plain: name ann?
dflt: name ann? = test
star: S name ann? kwo* | S name : S expr kwo* | S kwo kwo* | S name ann? kwo* , kwds | S kwo kwo* , kwds | S name ann? kwo* , | S kwo kwo* ,
kwo: , plain | , dflt
kwds: Q name ann? | Q name ann? ,
test: or | or I or L test | l : test | l lparams : test
lparams: lpos | lpos , | lpos , lstar | lstar | lpos , lkwds | lkwds
lpos: name% | ldef% | name% , ldef% | name% , / | name% , / , name% | name% , / , ldef% | ldef% , / | name% , / , name% , ldef%
ldef: name = test
lstar: S name lkwo* | S lkwo lkwo* | S name lkwo* , lkwds | S lkwo lkwo* , lkwds
lkwo: , name | , ldef
lkwds: Q name | Q name ,
named: test | name w test
stars: star1% | star1% ,
star1: test | S expr
or: not orm*
orm: O not
not: v* cmp
cmp: expr cmpm*
cmpm: < expr | > expr | C expr | Z expr | v Z expr | J expr | J v expr
expr: un bin*
bin: o un | u un | S un | z un | / un | @ un
un: sign* pow
sign: u | ~
pow: x? atom post* | x? atom post* Q un
strs: s strs?
atom: name | n | c | strs | e | ( ) | ( inpar ) | [ ] | [ list ] | { } | { dict } | { set }
inpar: named | yield | pstar% , | pstar , pstar% | named comp1 comp1*
pstar: named | S expr
list: pstar% | pstar% , | named comp1 comp1*
comp1: F tlist Z or cif* | j F tlist Z or cif*
cif: I or | I name w test | I l lparams? : test
set: pstar% | pstar% , | named comp1 comp1*
dict: ditem% | ditem% , | test : test comp1 comp1*
ditem: test : test | Q expr
post: . name | ( args? ) | [ subs ]
subs: sub% | sub% ,
sub: named | slice | S expr
slice: test? : test? | test? : test? : test?
args: argl | argl , | named comp1 comp1*
argl: posl | posl , kwl | posl , kwl , dkl | posl , dkl | kwl | kwl , dkl | dkl
posl: pstar%
kwl: name = test kwm*
kwm: , name = test | , S test
dkl: Q test dkm*
dkm: , Q test | , name = test
"""


_JS = """
file: $ stmt* $
name: i | h | j | f | r | k | 8
kw: n | I | E | F | W | D | Y | X | B | b | C | L | R | t | A | Q | T | O | P | K | x | N | U | M | H | V | Z | w | y | 2
any: name | kw
mname: any | s | [ expr ]
block: { stmt* }
stmt: block | ; | exprs ; | V bind% ; | I ( exprs ) stmt | I ( exprs ) stmt E stmt | F ( forhead ) stmt | F w ( forhead ) stmt | W ( exprs ) stmt | D stmt W ( exprs ) | Y ( exprs ) { clause* } | H ( exprs ) stmt | A block catch | A block fin | A block catch fin | R ; | R exprs ; | t exprs ; | B ; | B name ; | b ; | name : stmt | func | class | imp | exp
catch: X block | X ( bindel ) block
fin: Q block
clause: C exprs : stmt* | L : stmt*
forhead: V bind% ; exprs? ; exprs? | exprs? ; exprs? ; exprs? | V bindel Z exprs | lhs Z exprs | V bindel r expr | lhs r expr
bind: bindel | bindel = expr
bindel: name | { pprops? } | [ pelems? ]
pprops: pprop% | pprop% ,
pprop: mname : bindel | mname : bindel = expr | name | name = expr | e bindel
pelems: commas | commas? pelem pmore* commas?
pelem: bindel | bindel = expr | e bindel
pmore: commas pelem
commas: , ,*
exprs: expr%
expr: tern | lhs = expr | lhs g expr | arrow | y | y expr | y S expr
lhs: name | prim post* tend | obj | arr | ( lhs )
tend: . any | [ exprs ]
tern: bin | bin ? expr : expr
bin: un binm*
binm: o un | z un | & un | u un | S un | < un | > un | > > un | > > > un | Z un
un: pre* prim post* q?
pre: u | v | ! | T | O | q | w | N
prim: name | n | s | ( exprs ) | arr | obj | fexpr | K name? ext? { member* } | U ( args ) | U . name | N . name
post: . any | d any | d ( args? ) | d [ exprs ] | ( args? ) | [ exprs ] | s
args: arg% | arg% ,
arg: expr | e expr
obj: { } | { prop% } | { prop% , }
prop: mname : expr | name | name = expr | e expr | meth
meth: hs? mname ( params? ) block
hs: h | j | S | j S
arr: [ aelems? ]
aelems: commas | commas? arg amore* commas?
amore: commas arg
params: param% | param% ,
param: bindel | bindel = expr | e bindel
arrow: name a fbody | j name a fbody | ( params? ) a fbody | j ( params? ) a fbody
fbody: expr | block
func: j? P S? name ( params? ) block
fexpr: j? P S? name? ( params? ) block
deco: @ prim post*
class: deco* K name ext? { member* }
ext: x un
member: ; | deco* h? meth | deco* h? mname ; | deco* h? mname = expr ; | h block
imp: U s with? ; | U impc f s with? ;
with: H obj | k obj
impc: name | spec | S k name | name , spec | name , S k name
spec: { } | { ispec% } | { ispec% , }
ispec: any | s | any k any | any k s | s k any
exp: M L expr ; | M L fexpr | M L class | M L K ext? { member* } | M V bind% ; | M func | M class | M spec ; | M spec f s with? ; | M S f s with? ; | M S k any f s with? ;
"""

_TS = """
name: i | h | j | f | r | k | 8 | m | 1 | 3 | 4 | 5 | 6 | 7 | 9
type: fntype | utype | utype x utype ? type : type
fntype: tps? ( params? ) a rtype | m? N tps? ( params? ) a type
rtype: type | name 6 type | n 6 type | 7 any | 7 any 6 type
utype: uo? tun utm*
uo: z | &
utm: z tun | & tun
tun: tpre* tprim tpost* | 5 name x utype
tpre: 5 | m
tprim: name tdots* targs? | n | s | u n | ( type ) | { tm* } | [ ] | [ telem% ] | [ telem% , ] | T name tdots* targs? | T n tdots* | T U ( type ) tdots* | U ( type ) tdots* targs? | O
tdots: . any
tpost: [ ] | [ type ]
telem: type | name : type | name ? : type | e type | e name : type | type ?
targs: < type% >
tps: < tp% > | < tp% , >
tp: tpm* name | tpm* name x type | tpm* name = type | tpm* name x type = type
tpm: V | Z
annot: : type
rann: : rtype
tm: tmb ; | tmb ,
tmb: m* mname ?? annot? | tms* mname ?? tps? ( params? ) rann? | tps? ( params? ) rann? | N tps? ( params? ) rann? | um* [ name : type ] annot | um* [ name Z type ] opts? annot? | um* [ name Z type k type ] opts? annot?
tms: m | h
um: u? m
opts: u? ?
param: deco* m* bindel ?? annot? | deco* m* bindel ?? annot? = expr | e bindel annot? | n annot
bind: bindel !? annot? | bindel !? annot? = expr
catch: X block | X ( bindel annot? ) block
func: m* j? P S? name tps? ( params? ) rann? block | m* j? P S? name tps? ( params? ) rann? ;
fexpr: j? P S? name? tps? ( params? ) rann? block
arrow: name a fbody | j name a fbody | j? tps? ( params? ) rann? a fbody
meth: hs? mname ?? tps? ( params? ) rann? block
member: ; | deco* mod* meth | deco* mod* hs? mname ?? tps? ( params? ) rann? ; | deco* mod* mname opt? annot? ; | deco* mod* mname opt? annot? = expr ; | h block | mod* [ name : type ] annot ;
mod: m | h
opt: ? | !
class: deco* m* K name tps? ext? impl? { member* }
ext: x prim epost* targs?
epost: . any | ( args? )
impl: 9 type%
intf: m* 1 name tps? iext? { tm* }
iext: x type%
alias: m* 4 name tps? = type ;
enum: m* V? 2 name { } | m* V? 2 name { em% } | m* V? 2 name { em% , }
em: mname | mname = expr
ns: m* 3 name tdots* block | m* 3 s block | m* 3 s ; | m name block
stmt: block | ; | exprs ; | m* V bind% ; | I ( exprs ) stmt | I ( exprs ) stmt E stmt | F ( forhead ) stmt | F w ( forhead ) stmt | W ( exprs ) stmt | D stmt W ( exprs ) | Y ( exprs ) { clause* } | A block catch | A block fin | A block catch fin | R ; | R exprs ; | t exprs ; | B ; | B name ; | b ; | name : stmt | func | class | intf | alias | enum | ns | imp | exp
imp: U s with? ; | U impc f s with? ; | U 4 impc f s ; | U name = exprs ; | U 4 name = exprs ;
ispec: any | s | any k any | 4 any | 4 any k any | any k s | s k any
exp: M L expr ; | M L fexpr | M L func | M L class | M L intf | M L m* K tps? ext? impl? { member* } | M m* V bind% ; | M func | M class | M intf | M alias | M enum | M ns | M 4? spec ; | M 4? spec f s with? ; | M 4? S f s ; | M 4? S k any f s ; | M = expr ; | M k 3 name ; | M U name = exprs ;
post: . any | d any | d ( args? ) | d [ exprs ] | ( args? ) | [ exprs ] | s | ! | targs ( args? ) | targs s | targs
binm: o un | z un | & un | u un | S un | < un | > un | > > un | > > > un | Z un | k type | 8 type | k V
pre: u | v | ! | T | O | q | w | N | targs
lhs: name | prim post* tend | obj | arr | ( exprs ) | name ! | prim post* tend !
prim: name | n | s | ( exprs ) | arr | obj | fexpr | m? K name? tps? ext? impl? { member* } | U ( args ) | U . name | N . name
"""

_GO = """
file: $ k i ; top* $
top: U isp ; | U ( isps* ) ; | func ; | decl ; | ;
isps: isp ; | ;
isp: s | i s | . s
func: P recv? i tps? ( params? ) result? block?
recv: ( params )
result: type | ( params? )
tps: [ tp% ] | [ tp% , ]
tp: i | i tun
tun: tt tum*
tum: o tt
tt: type | ~ type
params: param% | param% ,
param: i type | type | i e type | e type
type: i targs? | i . i targs? | S type | [ ] type | [ expr ] type | [ e ] type | T { field* } | N { imeth* } | M [ type ] type | P ( params? ) result? | H type | a H type | H a type | ( type )
targs: [ type% ] | [ type% , ]
field: i% type s? ; | S? i targs? s? ; | S? i . i targs? s? ; | ;
imeth: i ( params? ) result? ; | tun ; | ;
decl: V spec | V ( specs* ) | y tspec | y ( tspecs* )
specs: spec ; | ;
tspecs: tspec ; | ;
spec: i% type? = exprs | i% type | i%
tspec: i tps? =? type
block: { stmts* }
stmts: stmt ; | ;
stmt: simple | decl | block | R | R exprs | B | B i | ifst | F block | F expr block | F simple? ; expr? ; simple? block | F rng block | W simple? { clause* } | W simple? ; simple? { clause* } | J { cclause* } | D expr | i : | i : stmt
ifst: I expr block else? | I simple? ; expr block else?
else: E ifst | E block
clause: C celem% : stmts* | L : stmts*
celem: expr | type
cclause: C simple : stmts* | L : stmts*
rng: Z expr | exprs = Z expr | exprs w Z expr
simple: expr | exprs = exprs | expr g expr | i% w exprs | expr q | expr a expr
exprs: expr%
expr: un binm*
binm: o un | u un | S un
un: pre* prim post*
pre: u | S | v | a
prim: i | n | s | ( expr ) | ( type ) | P ( params? ) result? block | ltype lit | ltype ( expr ) | i . i lit | i lit | i targs lit | T { field* } lit | N { imeth* } ( expr ) | H type ( expr )
ltype: [ ] type | [ expr ] type | [ e ] type | M [ type ] type
post: . i | . ( type ) | . ( y ) | ( args? ) | [ index% ] | [ index% , ] | [ slice ]
index: expr | type
slice: expr? : expr? | expr? : expr : expr
args: arg% | arg% , | arg% e | arg% e ,
arg: expr | type
lit: { } | { elem% } | { elem% , }
elem: val | val : val
val: expr | lit
"""

_JAVA = """
file: $ pkg? imp* tdecl* $
name: i | r | p | m | f | w
pkg: ann* k qn ;
qn: name qd*
qd: . name
imp: U M? qn ; | U M? qn . S ; | ;
tdecl: ; | decl
decl: mod* K name tps? xt? im? pm? { member* } | mod* 1 name tps? xts? pm? { member* } | mod* 2 name im? { ebody } | mod* r name tps? ( params? ) im? { member* } | mod* @ 1 name { member* }
mod: M | H | m | L | ann
ann: @ qn | @ qn ( ) | @ qn ( annarg% )
annarg: name = aval | aval
aval: tern | ann | { } | { aval% } | { aval% , }
xt: x type
xts: x type%
im: 9 type%
pm: p type%
tps: < tp% >
tp: ann* name | ann* name x type amp*
amp: & type
targs: < targ% > | < >
targ: type | ann* ? | ann* ? x type | ann* ? 5 type
type: ann* base dims*
base: T | ctype
ctype: name targs? cd*
cd: . ann* name targs?
dims: [ ]
member: ; | decl | mod* block | mod* tps? mod* rtype name ( params? ) dims* thr? mbody | mod* tps? name ( params? ) thr? block | mod* name block | mod* type declr% ;
rtype: type | O
mbody: block | ; | L aval ;
thr: 7 type%
params: param%
param: mod* type e? name dims* | mod* type n
declr: name dims* | name dims* = init
init: expr | ainit
ainit: { } | { init% } | { init% , } | { , }
ebody: econs? | econs? ; member*
econs: econ% | econ% ,
econ: ann* name | ann* name ( args? ) | ann* name { member* } | ann* name ( args? ) { member* }
block: { bst* }
bst: stmt | lvar ; | decl
lvar: mod* type declr%
stmt: block | ; | sexpr ; | I ( expr ) stmt | I ( expr ) stmt E stmt | F ( forhead ) stmt | W ( expr ) stmt | D stmt W ( expr ) ; | Y ( expr ) { sw* } | A block catch catch* fin? | A block fin | A ( res ) block catch* fin? | H ( expr ) block | R ; | R expr ; | t expr ; | B ; | B name ; | b expr ; | b expr : expr ; | f expr ; | name : stmt
catch: X ( mod* type alt* name ) block
alt: z type
fin: Q block
sw: C clab% guard? : bst* | L : bst* | C clab% guard? a swb | L a swb
swb: expr ; | block | t expr ;
clab: tern | L | pattern
guard: w expr
pattern: mod* type name | ctype ( ) | ctype ( pattern% ) | ctype ( pattern% ) name
sexpr: lhs = expr | lhs g expr | q un | prim post* q | prim post* ( args? ) | prim post* . targs name ( args? ) | newx | prim post* . newx
lhs: name | prim post* . name | prim post* [ expr ] | ( lhs )
expr: tern | lhs = expr | lhs g expr | lambda
lambda: name a lbody | ( ) a lbody | ( name% ) a lbody | ( params ) a lbody
lbody: expr | block
tern: bin | bin ? expr : expr
bin: un binm*
binm: o un | z un | & un | u un | S un | < un | > un | > > un | > > > un | Z type | Z pattern
un: pre* prim post* q? | pre* lambda
pre: u | v | q | ( type ) | ( type amp* )
prim: name | n | s | 5 | ( expr ) | newx | T dims* . K | O . K | Y ( expr ) { sw* } | T dims dims* y N | ctype dims dims* y N | ctype dims dims* . K | ctype y name | ctype y N
newx: N ann* T dimx dimx* dims* | N ann* ctype dimx dimx* dims* | N ann* base dims dims* ainit | N ann* ctype ( args? ) | N ann* ctype ( args? ) { member* }
dimx: [ expr ]
post: . name | . K | . n | . 5 | . newx | . targs name | ( args? ) | [ expr ] | y name | y N
args: expr%
res: r1 resm* ;?
resm: ; r1
r1: mod* type name = expr | prim post*
forhead: finit? ; expr? ; exprs? | mod* type name : expr
finit: lvar | exprs
exprs: sexpr%
"""

_C = """
file: $ ext* $
name: i
ext: decl | fdef | ; | name M* T decl2 | name M* T fdef2
decl2: tm* initd% ;
fdef2: tm* declr block
attr: @ ( ( args? ) )
qual: M | y | attr
dspecs: qual* base qual*
base: T tm* | name | sue
tm: T | M
sue: K attr* name | K attr* name? { field* } attr* | 2 attr* name | 2 attr* name? { en% } attr* | 2 attr* name? { en% , } attr*
en: name | name = tern
field: dspecs fdecl% ; | dspecs ; | ; | A ( args ) ;
fdecl: declr attr* | declr? : tern
decl: dspecs ; | dspecs initd% ; | A ( args ) ;
initd: declr attr* | declr attr* = init
init: expr | { } | { initel% } | { initel% , }
initel: init | desig desig* = init
desig: . name | [ tern ] | [ tern e tern ]
declr: ptr* direct
ptr: S | M | attr
direct: name dtail* | ( declr ) dtail*
dtail: [ M* tern? ] | [ S ] | ( params? )
params: param% | param% , e
param: dspecs attr* | dspecs declr attr* | dspecs abs
abs: ptr ptr* adir? | adir
adir: dtail dtail* | ( abs ) dtail*
fdef: dspecs declr block | dspecs declr kr kr* block
kr: dspecs declr% ;
typ: dspecs abs?
block: { bst* }
bst: decl | stmt | C tern : | L : | name :
stmt: block | ; | exprs ; | I ( exprs ) stmt | I ( exprs ) stmt E stmt | F ( forhead ) stmt | W ( exprs ) stmt | D stmt W ( exprs ) ; | Y ( exprs ) stmt | C tern : stmt | C tern e tern : stmt | L : stmt | R ; | R exprs ; | B ; | b name ; | name : stmt | 6 M* ( asm* ) ;
asm: strs | : | , | expr | [ name ]
forhead: exprs? ; exprs? ; exprs? | decl exprs? ; exprs?
exprs: expr%
expr: tern | un = expr | un g expr
tern: bin | bin ? exprs : tern
bin: un binm*
binm: o un | u un | S un | & un
un: pre* prim post*
pre: u | S | & | v | q | w | ( typ )
prim: name | n | strs | ( exprs ) | ( typ ) { } | ( typ ) { initel% } | ( typ ) { initel% , } | ( block ) | w ( typ )
strs: s sm*
sm: s | name
post: . name | ( args? ) | [ exprs ] | q
args: arg%
arg: expr | typ
"""

_CPP = """
file: $ ext* $
name: i | f
ext: decl | fdef | ; | tmpl | nsp | using | A7 | s? M s { ext* } | M s decl | M s fdef | attr ;
A7: 7 ( args ) ;
nsp: M? 3 attr* nsn? { ext* } | 3 name = qname ;
nsn: name nsm*
nsm: y name
using: U 3 qname ; | U V? qname ; | U name attr* = typ ; | U 2 qname ;
tmpl: P < > tmplb | P < tpar% > req? tmplb | P tmplb
tmplb: decl | fdef | tmpl | U name = typ ; | c name = cexp ;
cexp: expr
req: r cexp1
cexp1: cprim cand*
cand: 8 cprim | o cprim
cprim: qname | ( exprs ) | r ( params? ) { reqs* } | r { reqs* } | qname ( args? )
reqs: exprs ; | { exprs } 9? ; | { exprs } 9? a typ ; | V qname ; | r expr ;
tpar: tk e? name? | tk name? = typ | P < tpar% > tk name? | dspecs abs? | dspecs declr | dspecs declr = cx | qname e? name = typ
tk: K | V
attr: [ [ attrs? ] ] | @ ( ( args? ) )
attrs: att%
att: qname | qname ( args? )
qual: M | attr
dspecs: qual* base qual*
base: T tm* | V? qname | sue | d ( exprs ) | qname T
tm: T | M
qname: y? seg segm*
segm: y P? seg
seg: name | name targs | ~ name | A opr | A ctyp
ctyp: qual* base ptr*
targs: < > | < targ% >
targ: typ e? | cx e?
cx: un cxm*
cxm: o un | u un | S un | & un | 8 un | > o un
opr: o | u | S | & | 8 | = | g | < | > | > > | < o | ( ) | [ ] | q | v | ~ | N | N [ ] | x | x [ ] | a | , | a S | s name | s
sue: K attr* qname | K attr* qname? f? bases? { member* } | 2 K? attr* qname? und? | 2 K? attr* qname? und? { } | 2 K? attr* qname? und? { en% } | 2 K? attr* qname? und? { en% , }
und: : typ
en: name attr* | name attr* = cx
bases: : bs%
bs: bq* qname e?
bq: M | Q
member: decl | fdef | tmpl | using | A7 | ; | Q : | Q name : | qual* declr ; | qual* declr = spec0 ; | M K qname ; | M dspecs ;
spec0: L | x | n
decl: dspecs ; | dspecs initd% ; | dspecs ptr* [ name% ] = init ; | dspecs ptr* [ name% ] { init } ;
initd: declr attr* | declr attr* = init | declr attr* = spec0 | declr { inits? } | declr ( args ) | declr? : cx
init: expr | blist
blist: { inits? }
inits: initel% | initel% ,
initel: init e? | desig desig* = init | desig blist
desig: . name | [ cx ]
declr: ptr* direct
ptr: S | M | & | 8 | e | qname y S | attr
direct: qname attr* dtail* | ( declr ) dtail*
dtail: [ cx? ] | ( params? ) fq*
fq: M | & | 8 | 9 | 9 ( expr ) | f | a typ | t ( typs? ) | attr | req
typs: typ%
params: param% | param% , e | param% e | e
param: attr* dspecs e? | dspecs e? declr | dspecs abs | dspecs declr = init | dspecs abs = init | dspecs = init
abs: ptr ptr* adir? | adir
adir: atail atail* | ( abs ) atail*
atail: [ cx? ] | ( params? ) fq*
fdef: dspecs declr block | dspecs declr trybl | qual* declr block | qual* declr cinit block | qual* declr 1 cinit? block catch catch* | qual* declr ;
trybl: 1 block catch catch*
cinit: : mi%
mi: qname ( args? ) e? | qname { inits? } e?
typ: dspecs abs?
block: { bst* }
bst: decl | stmt | using | A7 | C cx : | L : | name : | 3 name = qname ; | P sue
stmt: attr* block | attr* ; | exprs ; | I M? ( cond ) stmt | I M? ( cond ) stmt E stmt | I M? ( cond ; cond ) stmt | I M? ( cond ; cond ) stmt E stmt | I M block | I M block E stmt | F ( forhead ) stmt | W ( cond ) stmt | D stmt W ( exprs ) ; | Y ( cond ) stmt | Y ( cond ; cond ) stmt | attr* C cx : stmt | C cx e cx : stmt | L : stmt | R ; | R exprs ; | R blist ; | B ; | b name ; | name : stmt | 1 block catch catch* | 6 M* ( asm* ) ;
asm: strs | : | , | expr | [ name ]
catch: X ( catchp ) block
catchp: dspecs | dspecs declr | dspecs abs | e
cond: exprs | dspecs declr = init | dspecs declr blist | dspecs ptr* [ name% ] = init
forhead: exprs? ; cond? ; exprs? | decl cond? ; exprs? | decl? attr* dspecs declr : init | decl? dspecs ptr* [ name% ] : init
exprs: expr%
expr: tern | un = init | un g init | t | t expr | w1 expr
w1: w2
w2: 5
tern: bin | bin ? exprs : expr
bin: un binm*
binm: o un | u un | S un | & un | 8 un | < un | > un | > > un | < o > un
un: pre* prim post*
pre: u | S | & | 8 | v | ~ | q | w | ( typ ) | x | x [ ] | y x | 5
prim: qname | n | strs | ( exprs ) | ( exprs e ) | ( e binop0 expr ) | ( expr binop0 e ) | ( expr binop0 e binop0 expr ) | w ( typ ) | w e ( name ) | lambda | newx | T ( args? ) | T blist | V qname ( args? ) | V qname blist | d ( exprs ) post0 | ( typ ) blist | ( block ) | r ( params? ) { reqs* } | r { reqs* } | d ( exprs ) blist | M M*
post0: y seg | ( args? )
binop0: o | u | S | & | 8 | , | < | >
newx: y? N pl? ntyp | y? N pl? ntyp ( args? ) | y? N pl? ntyp blist
pl: ( args )
ntyp: qual* nbase qual* nptr* ndim* | ( typ )
nbase: T tm* | V? qname
nptr: S | M
ndim: [ expr ]
lambda: [ caps? ] ltps? lpar? lq* block
ltps: < tpar% >
lpar: ( params? )
lq: M | 9 | a typ | attr
caps: cap% | cap% e
cap: = | & | & name | & name e | name | name e | name = init | & name = init | n | S n
strs: s sm*
sm: s | name
post: . P? seg2 | a P? seg2 | . S prim | ( args? ) | [ exprs ] | [ blist ] | q | blist | a S prim
seg2: seg | qname
args: arg% | arg% ,
arg: init e? | typ
"""

_RUST = """
file: $ iattr* item* $
name: i | k
iattr: # ! [ tt* ]
attr: # [ tt* ]
tt: J | ( tt* ) | [ tt* ] | { tt* }
vis: M | M ( X ) | M ( Z spath )
spath: y? seg0 sp*
seg0: name | X
sp: y seg0
item: attr* vis? idef | ;
idef: U use ; | fn | struct | enum | k name gen? where? { fields? } | V name : type = expr ; | V name : type ; | v m? name : type = expr ; | v m? name : type ; | trait | impl | 9? 4 name ; | 9? 4 name { iattr* item* } | 5 name gen? bounds? where? = type where? ; | 5 name gen? bounds? where? ; | 9? 6 s? { iattr* item* } | 6 X name ; | 6 X name A name ; | mac
mac: spath ! name? { tt* } | spath ! ( tt* ) ; | spath ! [ tt* ] ; | spath ! ( margs? ) ; | spath ! [ margs? ] ;
use: upath | upath A name | utree
upath: y? seg0 sp*
utree: S | { } | { use% } | { use% , } | upath y S | upath y { } | upath y { use% } | upath y { use% , } | y { use% }
fn: fq* P name gen? ( fparams? ) ret? where? block | fq* P name gen? ( fparams? ) ret? where? ;
fq: q | V | 9 | 6 s?
fparams: fparam% | fparam% ,
fparam: attr* pat : type | attr* self | attr* self : type | attr* e
self: m? X | & t? m? X
ret: a type
gen: < > | < gp% > | < gp% , >
gp: attr* name bounds? | attr* name bounds? = type | V name : type | V name : type = expr0 | attr* t lb?
expr0: lit | u n | block
lb: : | : t lbm*
lbm: u t
bounds: : | : bd bdm*
bdm: u bd
bd: ? path | path | t | hr path | ( bd ) | ~ V path | V path
hr: F gen
where: H | H wp% | H wp% ,
wp: t lb | hr? type bounds
struct: K name gen? where? ; | K name gen? where? { fields? } | K name gen? ( tfields? ) where? ;
fields: field% | field% ,
field: attr* vis? name : type
tfields: tfield% | tfield% ,
tfield: attr* vis? type
enum: 1 name gen? where? { } | 1 name gen? where? { var% } | 1 name gen? where? { var% , }
var: attr* vis? name disc? | attr* vis? name { fields? } disc? | attr* vis? name ( tfields? ) disc?
disc: = expr
trait: 9? k? 2 name gen? bounds? where? { iattr* item* }
impl: 9? 3 gen? type where? { iattr* item* } | 9? 3 gen? !? type F type where? { iattr* item* }
type: path | & t? m? type | 8 t? m? type | S V type | S m type | ( ) | ( type% ) | ( type% , ) | [ type ] | [ type ; expr ] | ! | ftype | hr ftype | hr path | d bd bdm* | 3 bd bdm* | spath ! ( tt* ) | ( d bd bdm* ) | ( 3 bd bdm* )
ftype: fq* P ( ftp? ) ret?
ftp: ftp1% | ftp1% , | ftp1% , e
ftp1: attr* type | name : type
path: y? seg segm* | < type > segm* | < type A path > segm*
segm: y seg
seg: sname | sname ga | sname y ga | sname ( types? ) ret? | sname y ( types? ) ret?
sname: name | X
types: type% | type% ,
ga: < > | < ga1% > | < ga1% , >
ga1: type | t | lit | u n | block | name ga? = type | name ga? bounds
lit: n | s
block: { iattr* stmt* tail? }
tail: attr* expr
stmt: ; | item | attr* let | attr* bexpr | attr* expr ; | spath ! { tt* } | spath ! { margs? }
let: L pat ; | L pat : type ; | L pat = expr ; | L pat : type = expr ; | L pat = expr E block ; | L pat : type = expr E block ;
bexpr: block | ifx | lab? W cond block | lab? D block | lab? F pat Z expr block | lab block | Q expr { iattr* arms? } | 9 block | q c? block | V block
lab: t :
ifx: I cond block | I cond block E block | I cond block E ifx
cond: expr | letc letm*
letc: L pat = scrut
letm: 8 un | 8 letc | o un
scrut: un sbin*
sbin: o un | u un | S un | & un | z un | A type
arms: arm ,? | arm , arms | bwa arms
arm: attr* pat guard? G expr
bwa: attr* pat guard? G bexpr
guard: I cond
pat: z? pat1 patm*
patm: z pat1
pat1: lit | u n | rb e rb | rb e | e rb | pm* name | pm* name @ pat1 | path | path ( pats? ) | path { fpats? } | ( pats? ) | [ pats? ] | & m? pat1 | 8 m? pat1 | e | spath ! ( tt* ) | V block
pm: r | m
rb: lit | u n | path
pats: pat% | pat% ,
fpats: fpat% | fpat% ,
fpat: attr* pm* name | attr* name : pat | attr* n : pat | attr* e
expr: range | un = expr | un g expr | R | R expr | B | B t | B expr | B t expr | closure
range: bin | bin e | bin e bin | e bin | e
bin: un binm* | un binm* 8 closure
binm: o un | O un | u un | S un | & un | 8 un | z un | < un | > un | > > un | A type
un: pre* prim post*
pre: u | S | ! | & | & m | 8 | 8 m | & r V | & r m
prim: path | n | s | ( ) | ( exprs ) | [ ] | [ exprs ] | [ expr ; expr ] | path { inits? } | bexpr | mcall | R | B | B t
exprs: attr0% | attr0% ,
attr0: attr* expr
mcall: spath ! ( tt* ) | spath ! [ tt* ] | spath ! { tt* } | spath ! ( margs? ) | spath ! [ margs? ] | spath ! { margs? }
margs: marg% | marg% , | expr ; expr
marg: expr | name = expr
inits: initf% | initf% , | e expr | initf% , e expr | initf% , e
initf: attr* name | attr* name : expr | attr* n : expr
post: . sname | . sname y ga | . n | . w | ( exprs? ) | [ expr ] | ?
closure: cm* z z expr | cm* z cps z expr | cm* O expr | cm* O a type block | cm* z z a type block | cm* z cps z a type block
cm: q | c | v | V
cps: cp% | cp% ,
cp: attr* pat1 | attr* pat1 : type
"""

GRAMMARS = {"javascript": _JS, "typescript": _JS + _TS, "go": _GO, "java": _JAVA, "c": _C, "cpp": _CPP, "rust": _RUST, "python": _PYTHON}
#: Where the ; before a closing bracket, or the end of the file, may be left out.
SOFT_END = {"javascript": "}$", "typescript": "}$", "go": ")}$"}


def parse(text: str) -> dict[str, list[list[str]]]:
    """A later rule of the same name replaces the earlier one."""
    rules: dict[str, list[list[str]]] = {}
    for line in filter(None, text.splitlines()):
        name, _, body = line.partition(": ") if ": " in line else line.partition(":")
        alternatives: list[list[str]] = [[]]
        for symbol in body.split():
            if symbol == "|":
                alternatives.append([])
            else:
                alternatives[-1].append(symbol)
        rules[name.strip()] = alternatives
    return rules


def derive(rules: dict[str, list[list[str]]], start: str = "file") -> set[str]:
    """Adjacent pairs of token classes that some sentence of the grammar can have."""
    nullable: dict[str, bool] = dict.fromkeys(rules, False)
    first: dict[str, set[str]] = {r: set() for r in rules}
    last: dict[str, set[str]] = {r: set() for r in rules}

    def base(symbol: str) -> str:
        return symbol[:-1] if len(symbol) > 1 and symbol[-1] in "*?" else symbol

    def empty(symbol: str) -> bool:
        return base(symbol) != symbol or nullable.get(symbol, False)

    def edge(symbol: str, sets: dict[str, set[str]]) -> set[str]:
        b = base(symbol)
        if len(b) == 1:
            return {b}
        return sets[b]

    changed = True
    while changed:
        changed = False
        for rule, alternatives in rules.items():
            for seq in alternatives:
                before = len(first[rule]), len(last[rule]), nullable[rule]
                for s in seq:
                    first[rule] |= edge(s, first)
                    if not empty(s):
                        break
                for s in reversed(seq):
                    last[rule] |= edge(s, last)
                    if not empty(s):
                        break
                nullable[rule] |= all(map(empty, seq))
                changed |= before != (len(first[rule]), len(last[rule]), nullable[rule])
    found: set[str] = set()
    reachable, todo = {start}, [start]
    while todo:
        for seq in rules[todo.pop()]:
            for s in map(base, seq):
                if len(s) > 1 and s not in reachable:
                    reachable.add(s)
                    todo.append(s)
    for rule in reachable:
        for seq in rules[rule]:
            for i, s in enumerate(seq):
                if s[-1] == "*" and len(s) > 1:
                    found |= {a + b for a in edge(s, last) for b in edge(s, first)}
                for t in seq[i + 1 :]:
                    found |= {a + b for a in edge(s, last) for b in edge(t, first)}
                    if not empty(t):
                        break
    return found


def expand(rules):
    """``rule%`` becomes rules of its own."""
    out = dict(rules)
    for alternatives in list(rules.values()):
        for seq in alternatives:
            for s in seq:
                if len(s) > 1 and s[-1] == "%":
                    out[s] = [[s[:-1], s + "m*"]]
                    out[s + "m"] = [[",", s[:-1]]]
    return out


@cache
def pairs(language: str) -> frozenset[str]:
    found = derive(expand(parse(GRAMMARS[language])))
    for closer in SOFT_END.get(language, ""):
        found |= {p[0] + closer for p in found if p[1] == ";"}
    return frozenset(found)
