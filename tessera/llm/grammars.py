"""Grammars and lexers of the supported languages, for the recogniser in ``gll``.

A lexer turns a text into one character a token, or None where it can't (an open string or comment, say). Operators
that a grammar needn't tell apart share a character: B is a binary operator, A an assignment with one. Where white space
ends statements, the lexer leaves line ends (JavaScript) or puts semicolons (Go); Python's blocks become brace groups.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

from tessera.llm.gll import Grammar

ID, NUM, STR, BIN, AUG, LF = "a", "0", '"', "B", "A", "N"
_CLASSES = {"ID": ID, "NUM": NUM, "STR": STR, "BIN": BIN, "AUG": AUG, "LF": LF}
_NUMBER, _WORD = r"\.?\d(?:[eEpP][+-]\d|[\w.'])*", r"[A-Za-z_$\x80-\U0010ffff][\w$]*"
#: Different tokens that a lexer remembers; beyond, it starts afresh.
_KNOWN = 300_000


def _trivia(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags | re.S | re.M)


class Lexer(dict):
    """Strings and comments by ``trivia`` (group c: comment, s: string, others: wrong), then words, then operators.

    As a dictionary it has the character of each token met so far."""

    space = r"\n"

    def __init__(self, grammar: Grammar, trivia: re.Pattern, ops: dict[str, list[str]], lines: Callable[[str], str] | None = None):
        super().__init__()
        self.grammar, self.trivia, self.lines = grammar, trivia, lines
        self.words = {w: c for w, c in grammar.literals.items() if w[0].isalpha()}
        table = {o: c for c, os in ops.items() for o in os}
        self.ops = table | {w: c for w, c in grammar.literals.items() if not w[0].isalpha() and len(w) > 1}
        several = sorted((o for o in self.ops), key=len, reverse=True)
        self.split = re.compile("|".join([_NUMBER, _WORD, *map(re.escape, several), self.space, r"\S"])).findall

    def __missing__(self, t: str) -> str:
        if len(self) > _KNOWN:
            self.clear()
        c = self[t] = self.ops.get(t) or self._class(t)
        return c

    def _class(self, t: str) -> str:
        if t[0].isdigit() or (t[0] == "." and t[1:2].isdigit()):
            return NUM
        if t[0].isspace() or (len(t) == 1 and not (t.isalnum() or t in "_$" or t >= "\x80")):
            return t
        return self.words.get(t, ID)

    def _piece(self, m: re.Match) -> str:
        k = m.lastgroup
        t = m.group()
        if k == "c":
            return "\n" if "\n" in t else " "
        if k == "s":
            return STR
        if k == "p":  # begins with what stands before the literal
            return t[: t.index("/")] + STR
        return t if k == "k" else "\1"

    def tokens(self, text: str) -> str | None:
        s = self.trivia.sub(self._piece, text)
        if "\1" in s:
            return None
        s = "".join(map(self.__getitem__, self.split(s)))
        return self.lines(s) if self.lines else s.replace("\n", "")

    def dialects(self, text: str) -> int:
        s = self.tokens(text)
        self.grammar.renew()
        return 0 if s is None else self.grammar.accepts(self.grammar.reduce(s))


# --- JSON ---

JSON = Grammar("""
File = Value ;
Value = STR | NUM | '-' NUM | 'true' | 'false' | 'null' | brace(Members) | brack(Items) ;
Members = ( Member ( ',' Member )* )? ;
Member = STR ':' Value ;
Items = ( Value ( ',' Value )* )? ;
""", ["json"], "File", _CLASSES, ())  # fmt: skip
_JSON_NUM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")


class _Json(Lexer):
    def _class(self, t):
        c = super()._class(t)
        return "\2" if c == ID or (c == NUM and not _JSON_NUM.match(t)) else c


# --- JavaScript and TypeScript ---

_JS = """
File = Stmt* ;
Stmts = Stmt* ;
End = ';' | LF ;
Nl = LF? ;
Name = ID | 'of' | 'async' | 'get' | 'set' | 'static' | 'from' | 'as' | 'type' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'keyof' | 'is' | 'public' | 'private' | 'protected' | 'interface' | 'implements' | 'infer' | 'asserts' | 'satisfies' | 'unique' | 'global' | 'override' | 'accessor' | 'let' | 'await' | 'yield' ;
Any = Name | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'switch' | 'case' | 'default' | 'throw' | 'try' | 'catch' | 'finally' | 'function' | 'class' | 'extends' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'var' | 'const' | 'import' | 'export' | 'enum' | 'with' | 'debugger' ;
Stmt = Simple End | Decl | End | brace(Stmts) | 'if' paren(Exprs) Nl Body ( Nl 'else' Nl Body )? | 'for' 'await'? paren(ForHead) Nl Body | 'while' paren(Exprs) Nl Body
  | 'do' Nl Body Nl 'while' paren(Exprs) ';'? | 'try' brace(Stmts) ( Nl 'catch' paren(Binding)? brace(Stmts) )? ( Nl 'finally' brace(Stmts) )?
  | 'switch' paren(Exprs) brace(Cases) | Name ':' Nl Stmt | 'with' paren(Exprs) Body ;
Body = Stmt | Simple ;
Last = Simple ;
Simple = Exprs | Vars | 'return' Exprs? | 'throw' Exprs | 'break' Name? | 'continue' Name? | 'debugger' | Import | 'export' Vars | 'export' 'default' Expr | 'export' '*' ( 'as' Any )? 'from' STR | 'export' 'type'? brace(Specs) ( 'from' STR )?
  | @ts 'type' Name TParams? '=' '|'? Type | @ts 'export' 'type' Name TParams? '=' '|'? Type | @ts 'export' '=' Expr | @ts 'declare' ( Vars | Head ) | @ts 'export'? 'declare' ( Vars | Head ) | @ts Head | @ts 'export' 'default'? Head ;
Vars = ( 'var' | 'let' | 'const' ) Var ( ',' Var )* ;
Var = Target ( @ts '!'? Ann )? ( '=' Expr )? ;
Target = Name | brace(ObjPat) | brack(ArrPat) ;
Binding = Target ( @ts Ann )? ;
ObjPat = ( Prop ( ',' Prop )* ','? )? ;
Prop = Name ( '=' Expr )? | Key ':' Target ( '=' Expr )? | '...' Target ;
ArrPat = ( Elem? ( ',' Elem? )* )? ;
Elem = '...'? Target ( '=' Expr )? ;
Import = 'import' STR With? | 'import' 'type'? What 'from' STR With? | @ts 'import' Name '=' Post ;
With = 'with' brace(ObjBody) ;
What = Name ( ',' ( '*' 'as' Name | brace(Specs) ) )? | '*' 'as' Name | brace(Specs) ;
Specs = ( Spec ( ',' Spec )* ','? )? ;
Spec = 'type'? ( Any | STR ) ( 'as' ( Any | STR ) )? ;
Decl = Deco* ( 'export' 'default'? )? Deco* Made ;
Made = Func | Class | @ts 'declare' Made | @ts 'interface' Name TParams? ( 'extends' Types )? brace(TMembers) | @ts 'const'? 'enum' Name brace(Enums) | @ts ( 'namespace' | 'module' ) ( Name ( '.' Name )* | STR ) brace(Stmts) | @ts 'declare' 'global' brace(Stmts) ;
Head = 'async'? 'function' '*'? Name? TParams? paren(Params) Ret? ;
Func = 'async'? 'function' '*'? Name? ( @ts TParams )? paren(Params) ( @ts Ret )? brace(Stmts) ;
Class = ( @ts 'abstract' )? 'class' Name? ( @ts TParams )? ( 'extends' Post ( @ts TArgs )? )? ( @ts 'implements' Types )? brace(ClassBody) ;
ClassBody = Member* ;
Deco = '@' Post Nl ;
Mod = 'static' | 'async' | 'get' | 'set' | '*' | @ts 'public' | @ts 'private' | @ts 'protected' | @ts 'readonly' | @ts 'abstract' | @ts 'override' | @ts 'declare' | 'accessor' ;
Member = End | Deco* Mod* Key ( @ts ( '?' | '!' ) )? ( @ts TParams )? paren(Params) ( @ts Ret )? brace(Stmts) | Deco* Mod* Key ( @ts ( '?' | '!' )? Ann? )? ( '=' Expr )? End | 'static' brace(Stmts)
  | @ts Deco* Mod* Key '?'? TParams? paren(Params) Ret? End | @ts Mod* brack(Index) Ann End ;
LastMember = Deco* Mod* Key ( @ts ( '?' | '!' )? Ann? )? ( '=' Expr )? ;
Key = Any | STR | NUM | brack(Expr) | '#' Any ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Deco* ( @ts ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )* )? '...'? ( Target | @ts 'this' ) ( @ts '?'? Ann? )? ( '=' Expr )? ;
ForHead = ( Vars | Exprs )? ';' Exprs? ';' Exprs? | ( 'var' | 'let' | 'const' )? ( Target | Post ) ( 'of' | 'in' ) Exprs ;
Cases = Case* ;
Case = ( 'case' Exprs | 'default' ) ':' Nl Stmt* Simple? ;
Exprs = Expr ( ',' Expr )* ;
Expr = Post ( '=' | AUG ) Expr | Cond | Arrow | 'yield' '*'? Expr? ;
Arrow = 'async'? ( Name | ( @ts TParams )? paren(Params) ( @ts Ret )? ) '=>' ( brace(Stmts) | Expr ) ;
Cond = Bin ( '?' Expr ':' Expr )? ;
Bin = Un ( Op Un | ( @ts ( 'as' | 'satisfies' ) Type ) )* ;
Op = BIN | '<' | '>' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '&' | '|' | 'in' | 'instanceof' ;
Pre = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' ;
Un = Pre* Post ( '++' | '--' )? ;
Post = Prim Tail* ;
Tail = ( '.' | '?.' ) ( Any | '#' Any ) | '?.'? brack(Exprs) | '?.'? paren(Args) | STR | @ts '!' | @ts TArgs paren(Args) ;
Prim = Name | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | paren(Exprs) | brack(Args) | brace(ObjBody) | Func | Class | 'import' | 'new' '.' Name | '#' Any ;
Args = ( Arg? ( ',' Arg? )* )? ;
Arg = '...'? Expr ;
ObjBody = ( Field ( ',' Field )* ','? )? ;
Field = Key ':' Expr | Name ( '=' Expr )? | '...' Expr | ( 'async' | 'get' | 'set' | '*' )* Key ( @ts TParams )? paren(Params) ( @ts Ret )? brace(Stmts) ;
Ann = ':' Type ;
Ret = ':' ( 'asserts'? Name 'is' )? Type | ':' 'this' 'is' Type | ':' 'asserts' Name ;
Types = Type ( ',' Type )* ;
TArgs = '<' Types '>' ;
TParams = '<' TParam ( ',' TParam )* ','? '>' ;
TParam = 'const'? 'in'? Name ( 'extends' Type )? ( '=' Type )? ;
Type = TUnion ( 'extends' TUnion '?' Type ':' Type )? | TParams? paren(Params) '=>' Ret2 | 'abstract'? 'new' TParams? paren(Params) '=>' Type ;
Ret2 = ( Name 'is' )? Type ;
TUnion = '|'? TUn ( ( '|' | '&' ) TUn )* ;
TUn = ( 'keyof' | 'readonly' | 'unique' | 'typeof' | 'infer' )* TPrim TTail* ;
TTail = brack(TOpt) | '.' Any | TArgs ;
TOpt = Type? ;
TPrim = Name | STR | '-'? NUM | 'null' | 'void' | 'true' | 'false' | 'this' | 'import' paren(Type) | paren(Type) | brack(Tuple) | brace(TMembers) ;
Tuple = ( TElem ( ',' TElem )* ','? )? ;
TElem = '...'? ( Name '?'? ':' )? Type '?'? ;
TMembers = ( TMember ( ( ',' | ';' | LF )+ TMember )* )? ( ',' | ';' | LF )* ;
TMember = ( 'readonly' | 'get' | 'set' | '-' | '+' )* Key '?'? ( Ann | TParams? paren(Params) Ret? )? | TParams? paren(Params) Ret? | 'new' TParams? paren(Params) Ret? | ( 'readonly' | '-' | '+' )* brack(Index) ( '-' | '+' )? '?'? Ann ;
Index = Name ( ':' | 'in' ) Type ( 'as' Type )? ;
Enums = ( Enum ( ',' Enum )* ','? )? ;
Enum = Key ( '=' Expr )? ;
"""
# the last statement of a block, of a file and of a class needs no terminator
_JS = _JS.replace("Stmts = Stmt* ;", "Stmts = Stmt* Simple? ;").replace("File = Stmt* ;", "File = Stmt* Simple? ;").replace("Last = Simple ;\n", "")
_JS = _JS.replace("ClassBody = Member* ;", "ClassBody = Member* LastMember? ;")
JS = Grammar(_JS, ["js", "ts"], "File", _CLASSES, ("Stmt", "Simple", "Member", "LastMember"))
_C_STR = r'"(?:\\.|[^"\\\n])*"'
_JS_ESC = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu])"
_JS_PLAIN = rf'"(?:{_JS_ESC}|[^"\\\n])*"' + rf"|'(?:{_JS_ESC}|[^'\\\n])*'"
_JS_NOTE = r"(?P<c>//[^\n]*|/\*.*?\*/|\A\#![^\n]*)"
# a slash begins a literal after an operator, a word that an operand follows, the head of a statement, or at the begin of a line
_JS_REGEX = r"(?P<p>(?:[=(,:;!&|?{}\[+~^%<>*-][ \t]*|^[ \t]*|\b(?:return|typeof|case|else|void|delete|in|of|yield|await|throw|do)[ \t]+|\b(?:if|while|with)[ \t]*\((?:[^()\n\"'`/]|\([^()\n\"'`/]*\))*\)[ \t]*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)"
_JS_TRIVIA = _trivia(_JS_NOTE + rf"|(?P<s>{_JS_PLAIN}|`(?:\\.|[^`\\])*`)|" + _JS_REGEX + r"|(?P<x>[\"'`]|/\*)")
#: Whether a template literal can stand within another one, which takes a pattern that calls itself.
_JS_NESTED = re.compile(r"\$\{[^`}]*`")
_JS_DEEP = (
    _JS_NOTE + rf"|(?P<s>{_JS_PLAIN}|(?P<t>`(?:\\.|\$\{{(?P<e>(?:[^{{}}`\"'/\\]|/(?![/*])|//[^\n]*|/\*.*?\*/|{_JS_PLAIN}|(?&t)|\{{(?&e)\}})*+)\}}|\$(?!\{{)|[^`\\$])*+`))|" + _JS_REGEX + r"|(?P<x>[\"'`]|/\*)"
)


class _Js(Lexer):
    deep = None

    def tokens(self, text: str) -> str | None:
        if not _JS_NESTED.search(text):
            return super().tokens(text)
        if _Js.deep is None:
            _Js.deep = regex.compile(_JS_DEEP, regex.S | regex.M)
        plain, self.trivia = self.trivia, _Js.deep
        try:
            return super().tokens(text)
        finally:
            self.trivia = plain

    def _piece(self, m) -> str:
        return STR if m.group("s") is not None else super()._piece(m)


_JS_OPS = {
    BIN: ["==", "!=", "===", "!==", "<=", "&&", "||", "??", "<<", "**", "%", "^", ">="],
    AUG: ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="],
}


def _js_lines(g: Grammar):
    w = g.literals
    ends = "".join([ID, NUM, STR, ")", "]", "}", w["++"], w["--"], *(w[k] for k in ("this", "super", "null", "true", "false", "return", "break", "continue", "debugger", "of", "async", "get", "set", "static", "from", "as", "type", "let", "yield"))])
    starts = "".join([ID, NUM, STR, "{", "!", "~", "@", "#", w["++"], w["--"], "}", *(c for k, c in w.items() if k[0].isalpha() and k not in ("in", "instanceof", "of", "as", "is", "extends", "implements", "satisfies"))])
    at = re.compile(rf"([{re.escape(ends)}])[ \t\r]*\n\s*(?=[{re.escape(starts)}]|\Z)")
    # before a brace or after one a line end is only kept where a statement can end there
    return lambda s: re.sub(r"\s+", "", re.sub(rf"{LF}(?=\}})|(?<=[)]){LF}(?=\{{)", "", at.sub(rf"\1{LF}", s)))


# --- Go ---

GO = Grammar("""
File = 'package' ID ';' Import* Top* ;
Import = 'import' ImpSpec ';' | 'import' paren(ImpSpecs) ';' ;
ImpSpecs = ( ImpSpec ';' )* ;
ImpSpec = ( ID | '.' )? STR ;
Top = Decl ';' | 'func' ID TParams? Sig brace(Stmts)? ';' | 'func' paren(Params) ID Sig brace(Stmts)? ';' ;
TParams = brack(TParam) ;
TParam = ID ( ',' ID )* Con ( ',' ID ( ',' ID )* Con )* ','? ;
Con = '~'? Type ( '|' '~'? Type )* ;
Sig = paren(Params) ( Type | paren(Params) )? ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Type | ID '...'? Type | '...' Type ;
Decl = 'var' VarSpec | 'var' paren(VarSpecs) | 'const' ConstSpec | 'const' paren(ConstSpecs) | 'type' TypeSpec | 'type' paren(TypeSpecs) ;
VarSpecs = ( VarSpec ';' )* ;
VarSpec = Ids ( Type ( '=' Exprs )? | '=' Exprs ) ;
ConstSpecs = ( ConstSpec ';' )* ;
ConstSpec = Ids ( Type? '=' Exprs )? ;
TypeSpecs = ( TypeSpec ';' )* ;
TypeSpec = ID TParams? '='? Type ;
Ids = ID ( ',' ID )* ;
Type = ID ( '.' ID )? TArgs? | '*' Type | brack(Len) Type | 'map' brack(Type) Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig | 'struct' brace(Fields) | 'interface' brace(Methods) | paren(Type) ;
TArgs = brack(Types) ;
Types = Type ( ',' Type )* ','? ;
Len = Expr? | '...' ;
Fields = ( Field ';' )* Field? ;
Field = Ids Type STR? | '*'? ID ( '.' ID )? TArgs? STR? ;
Methods = ( Method ';' )* Method? ;
Method = ID Sig | Con ;
Stmts = ( Stmt? ';' )* Stmt? ;
Stmt = Decl | Simple | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' Expr | 'defer' Expr | brace(Stmts) | If | For | Switch | 'select' brace(Comms) | ID ':' ';'? Stmt? ;
Simple = Expr | Exprs ( '=' | ':=' | AUG ) Exprs | Expr ( '++' | '--' ) | Expr '<-' Expr ;
If = 'if' ( Simple? ';' )? Expr brace(Stmts) ( 'else' ( If | brace(Stmts) ) )? ;
For = 'for' ( Expr | Simple? ';' Expr? ';' Simple? | ( Exprs ( '=' | ':=' ) )? 'range' Expr )? brace(Stmts) ;
Switch = 'switch' ( Simple? ';' )? Expr? brace(Cases) | 'switch' ( Simple? ';' )? ( ID ':=' )? Post '.' paren(TypeWord) brace(Cases) ;
TypeWord = 'type' ;
Cases = Case* ;
Case = ( 'case' ( Exprs | Types ) | 'default' ) ':' ( Stmt? ';' )* Stmt? ;
Comms = Comm* ;
Comm = ( 'case' Simple | 'default' ) ':' ( Stmt? ';' )* Stmt? ;
Exprs = Expr ( ',' Expr )* ;
Expr = Un ( Op Un )* ;
Op = BIN | '<' | '>' | '+' | '-' | '*' | '/' | '&' | '|' | '^' ;
Un = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' )* Post ;
Post = Prim Tail* ;
Tail = '.' ID | brack(Sub) | paren(Args) | '.' paren(Type) | brace(Lit) ;
Sub = Expr | Types | Expr? ':' Expr? ( ':' Expr )? ;
Args = ( Arg ( ',' Arg )* '...'? ','? )? ;
Arg = Expr | Type ;
Prim = ID | NUM | STR | paren(ParenE) | 'func' Sig brace(Stmts) | brack(Len) Type | 'map' brack(Type) Type | 'struct' brace(Fields) | 'chan' Type | 'interface' brace(Methods) ;
ParenE = Expr | Type ;
Lit = ( Item ( ',' Item )* ','? )? ;
Item = ( Elem ':' )? Elem ;
Elem = Expr | brace(Lit) ;
""", ["go"], "File", _CLASSES, ("Stmt", "Top"))  # fmt: skip
_GO_OPS = {BIN: ["==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "&^", "%"], AUG: ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="]}
_GO_ESC = r"\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_GO_TRIVIA = _trivia(r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>\"(?:" + _GO_ESC + r"|\\\"|[^\"\\\n])*\"|`[^`]*`|'(?:" + _GO_ESC + r"|\\'|[^'\\\n])')|(?P<x>[\"'`]|/\*)")


def _go_lines(g: Grammar):
    w = g.literals
    ends = "".join([ID, NUM, STR, ")", "]", "}", *(w[k] for k in ("++", "--", "return", "break", "continue", "fallthrough"))])
    at = re.compile(rf"([{re.escape(ends)}])[ \t\r]*(?:\n\s*|\Z)")
    return lambda s: re.sub(r"\s+", "", at.sub(r"\1;", s))


# --- Java ---

JAVA = Grammar("""
File = ( Anno* 'package' Qual ';' )? ( 'import' 'static'? Qual ( '.' '*' )? ';' | 'import' 'module' Qual ';' | ';' )* ( Type | @compact Top )* ;
Top = Mod* TParams? ( 'void' | Ref ) Id paren(Params) Dims Throws? brace(Stmts) | Mod* Ref Vars ';' ;
Qual = Id ( '.' Id )* ;
Id = ID | 'module' | 'record' | 'sealed' | 'permits' | 'yield' | 'var' ;
Type = ';' | Mod* Kind ;
Kind = 'class' Id TParams? ( 'extends' Ref )? ( 'implements' Refs )? ( 'permits' Refs )? brace(Body) | 'interface' Id TParams? ( 'extends' Refs )? ( 'permits' Refs )? brace(Body)
  | 'enum' Id ( 'implements' Refs )? brace(EnumBody) | 'record' Id TParams? paren(Params) ( 'implements' Refs )? brace(Body) | '@' 'interface' Id brace(Body) ;
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | Anno ;
Anno = '@' Qual paren(AnnoArgs)? ;
AnnoArgs = ( ( Id '=' )? AnnoVal ( ',' Id '=' AnnoVal )* )? ;
AnnoVal = Expr | Anno | brace(AnnoVals) ;
AnnoVals = ( AnnoVal ( ',' AnnoVal )* ','? )? ;
TParams = '<' TParam ( ',' TParam )* '>' ;
TParam = Anno* Id ( 'extends' Ref ( '&' Ref )* )? ;
Refs = Ref ( ',' Ref )* ;
Ref = Anno* Base Dims ;
Base = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | Id TArgs? ( '.' Id TArgs? )* ;
Dims = brack(None)* ;
None = ;
TArgs = '<' ( TArg ( ',' TArg )* )? '>' ;
TArg = Ref | Anno* '?' ( ( 'extends' | 'super' ) Ref )? ;
Body = Member* ;
EnumBody = ( Const ( ',' Const )* ','? )? ( ';' Member* )? ;
Const = Anno* Id paren(Args)? brace(Body)? ;
Member = ';' | Mod* Kind | Mod* TParams? ( 'void' | Ref ) Id paren(Params) Dims Throws? ( brace(Stmts) | ';' ) | Mod* TParams? Id paren(Params) Throws? brace(Stmts) | Mod* Id brace(Stmts) | Mod* Ref Vars ';' | 'static'? brace(Stmts)
  | Mod* Ref Id paren(Params) 'default' AnnoVal ';' ;
Throws = 'throws' Refs ;
Params = ( Param ( ',' Param )* )? ;
Param = ( 'final' | Anno )* Ref '...'? ( Id Dims | 'this' ) ;
Vars = Var ( ',' Var )* ;
Var = Id Dims ( '=' Init )? ;
Init = Expr | brace(Inits) ;
Inits = ( Init ( ',' Init )* ','? )? ;
Stmts = Stmt* ;
Local = ( 'final' | Anno )* Ref Vars ;
Stmt = ';' | Local ';' | Mod* Kind | Expr ';' | brace(Stmts) | 'if' paren(Expr) Stmt ( 'else' Stmt )? | 'while' paren(Expr) Stmt | 'do' Stmt 'while' paren(Expr) ';' | 'for' paren(ForHead) Stmt
  | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | Try | 'switch' paren(Expr) brace(Cases) | 'synchronized' paren(Expr) brace(Stmts) | Id ':' Stmt | 'assert' Expr ( ':' Expr )? ';' ;
Try = 'try' paren(Resources)? brace(Stmts) Catch* ( 'finally' brace(Stmts) )? ;
Catch = 'catch' paren(Caught) brace(Stmts) ;
Caught = ( 'final' | Anno )* Ref ( '|' Ref )* Id ;
Resources = Resource ( ';' Resource )* ';'? ;
Resource = ( 'final' | Anno )* Ref Id '=' Expr | Expr ;
ForHead = ( Local | Exprs )? ';' Expr? ';' Exprs? | ( 'final' | Anno )* Ref Id ':' Expr ;
Cases = Case* ;
Case = ( 'case' Pat ( ',' Pat )* ( 'when' Expr )? | 'default' ) ( ':' Stmt* | '->' ( Expr ';' | brace(Stmts) | 'throw' Expr ';' ) ) ;
Pat = Cond | Ref Id | 'default' | Ref paren(Pats) Id? ;
Pats = ( Pat ( ',' Pat )* )? ;
Exprs = Expr ( ',' Expr )* ;
Expr = Post ( '=' | AUG ) Expr | Cond | Lambda ;
Lambda = ( Id | paren(LParams) ) '->' ( Expr | brace(Stmts) ) ;
LParams = ( Id ( ',' Id )* )? | Params ;
Cond = Bin ( '?' Expr ':' ( Expr ) )? ;
Bin = Un ( Op Un | 'instanceof' 'final'? Ref Id? | 'instanceof' Pat )* ;
Op = BIN | '<' | '>' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '&' | '|' ;
Un = ( '+' | '-' | '!' | '~' | '++' | '--' | paren(Cast) )* ( Post ( '++' | '--' )? | Lambda ) ;
Cast = Ref ( '&' Ref )* ;
Post = Prim Tail* ;
Tail = '.' TArgs? ( Id | 'class' | 'this' | 'super' | 'new' Base paren(Args) brace(Body)? ) | brack(Expr) | paren(Args) | '::' ( Id | 'new' ) ;
Args = ( Expr ( ',' Expr )* )? ;
Prim = Id | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | paren(Expr) | 'new' Anno* Base paren(Args) brace(Body)? | 'new' Base ( brack(Expr) | brack(None) )+ brace(Inits)? | Ref '.' 'class' | 'void' '.' 'class' | Ref '::' ( Id | 'new' )
  | 'switch' paren(Expr) brace(Cases) ;
""", ["java", "compact"], "File", _CLASSES, ("Stmt", "Member"))  # fmt: skip
_JAVA_OPS = {BIN: ["==", "!=", "<=", ">=", "&&", "||", "<<", "%", "^"], AUG: ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="]}
_JAVA_ESC = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})"
_JAVA_TRIVIA = _trivia(rf'(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>"""(?:{_JAVA_ESC}|\\\r?\n|[^\\])*?"""|"(?:{_JAVA_ESC}|[^"\\\n])*"|' + rf"'(?:{_JAVA_ESC}|[^'\\\n])')" + r"|(?P<x>[\"'`]|/\*)")

# --- C and C++ ---

CPP = Grammar("""
File = Top* ;
Tops = Top* ;
Name = ID ( TArgs )? ;
Qual = '::'? Name ( '::' ( '~'? Name | Oper ) )* ;
Oper = 'operator' ( BIN | AUG | '<' | '>' | '+' | '-' | '*' | '/' | '&' | '|' | '=' | '!' | '~' | '++' | '--' | '->' | ',' | paren(None) | brack(None) | '<' '<' | '>' '>' | Type | 'new' | 'delete' ) ;
None = ;
Attr = brack(AttrIn) ;
AttrIn = brack(Any) ;
Any = ( ID | NUM | STR | ',' | '::' | paren(Any) | '=' | '<' | '>' | BIN | '+' | '-' | '*' | '/' | '&' | '|' | '.' | '!' | 'const' | brack(Any) )* ;
Top = 'namespace' ( Qual )? brace(Tops) | 'inline' 'namespace' ID brace(Tops) | 'namespace' ID '=' Qual ';' | 'extern' STR ( brace(Tops) | Top ) | Template* Decl | 'using' ( 'namespace' | 'typename' )? Qual ( '=' Type )? ';' | ';' | 'static_assert' paren(Args) ';' ;
Template = 'template' '<' ( TPar ( ',' TPar )* )? '>' ( 'requires' Bin )? ;
TPar = Template* ( 'typename' | 'class' ) '...'? ID? ( '=' Type )? | Qual '...'? ID ( '=' TVal )? | Type '...'? ID? ( '=' TVal )? ;
TArgs = '<' ( TVal '...'? ( ',' TVal '...'? )* )? '>' ;
TVal = Type paren(Params)? | TExpr ;
TExpr = Un ( ( BIN | '+' | '-' | '*' | '/' | '&' | '|' ) Un )* ;
Spec = 'const' | 'volatile' | 'static' | 'inline' | 'extern' | 'virtual' | 'explicit' | 'constexpr' | 'consteval' | 'constinit' | 'mutable' | 'friend' | 'register' | 'typedef' | 'thread_local' | 'typename' | Attr | 'restrict' ;
Prim0 = 'unsigned' | 'signed' | 'long' | 'short' | 'int' | 'char' | 'bool' | 'float' | 'double' | 'void' | 'wchar_t' ;
Base = Prim0+ | Qual | 'auto' | 'decltype' paren(Expr) | ( 'struct' | 'class' | 'enum' | 'union' ) Qual ;
Type = Spec* Base Spec* Ptr* ;
Ptr = '*' ( 'const' | 'volatile' | 'restrict' )* | '&' | '&&' | Qual '::' '*' ;
Decl = Spec* Class Spec* Dectors? ';' | Spec* Enum Dectors? ';' | Spec* Base Spec* Dectors ';' | Spec* Base? Spec* Ptr* Func | Spec* Base Spec* ';' | Spec* Prim0* ';' ;
Class = ( 'class' | 'struct' | 'union' ) Attr? Qual? 'final'? ( ':' Bases )? brace(Members) ;
Bases = BaseC ( ',' BaseC )* ;
BaseC = ( 'public' | 'private' | 'protected' | 'virtual' )* Qual '...'? ;
Enum = 'enum' ( 'class' | 'struct' )? ID? ( ':' Type )? brace(Enums) ;
Enums = ( ID Attr? ( '=' Cond )? ( ',' ID Attr? ( '=' Cond )? )* ','? )? ;
Members = Member* ;
Member = ( 'public' | 'private' | 'protected' | ID ) ':' | Top ;
Dectors = Dector ( ',' Dector )* ;
Dector = Ptr* ( Qual | paren(Inner) | brack(Ids) )? Suffix* ( ':' Cond )? Init? ;
Ids = ID ( ',' ID )* ;
Inner = Ptr+ Qual? Suffix* | Qual '::' '*' Qual Suffix* ;
Suffix = brack(Opt) | paren(Params) FTail* ;
Opt = Expr? ;
Init = '=' IVal | brace(IVals) | paren(Args) | '=' ( 'default' | 'delete' ) ;
IVal = Asg | brace(IVals) ;
IVals = ( Item ( ',' Item )* ','? )? ;
Item = ( '.' ID '=' | brack(Expr) '=' )? IVal '...'? ;
Func = ( Qual | '~' ID | Oper | Qual '::' '~' ID ) paren(Params) FTail* ( ':' Inits )? 'try'? brace(Stmts) Catch* | ( '~' ID | Oper | ID ) paren(Params) FTail* ( '=' ( NUM | 'default' | 'delete' ) )? ';' ;
FTail = 'const' | 'volatile' | 'noexcept' paren(Expr)? | 'override' | 'final' | '&' | '&&' | '->' Type | 'throw' paren(Types) | Attr | 'requires' Bin ;
Types = ( Type ( ',' Type )* )? ;
Inits = MInit ( ',' MInit )* ;
MInit = Qual ( paren(Args) | brace(IVals) ) '...'? ;
Params = ( Param ( ',' Param )* ( ',' '...' )? | '...' )? ;
Param = Attr? Type '...'? ( ID | paren(Inner) | 'this' )? Suffix* ( '=' IVal )? ;
Stmts = Stmt* ;
Stmt = ';' | Expr ';' | Local | brace(Stmts) | 'if' 'constexpr'? paren(Head) Stmt ( 'else' Stmt )? | 'while' paren(Head) Stmt | 'do' Stmt 'while' paren(Expr) ';' | 'for' paren(ForHead) Stmt | 'return' ( Expr | brace(IVals) )? ';' | 'co_return' Expr? ';'
  | 'break' ';' | 'continue' ';' | 'goto' ID ';' | 'try' brace(Stmts) Catch+ | 'switch' paren(Head) Stmt | 'case' Cond ( '...' Cond )? ':' | 'default' ':' | ID ':' | 'static_assert' paren(Args) ';' | Attr Stmt ;
Local = Spec* Class Spec* Dectors? ';' | Spec* Enum Dectors? ';' | Spec* Base Spec* Dectors ';' | 'using' ( 'namespace' | 'typename' )? Qual ( '=' Type )? ';' ;
Catch = 'catch' paren(Caught) brace(Stmts) ;
Caught = '...' | Type ID? ;
Head = ( Local )? ( Expr | Type ID ( '=' Expr | brace(IVals) ) ) | Expr ';' Expr ;
ForHead = ( Local | Expr? ';' ) Expr? ';' Expr? | ( Local )? Type ( ID | brack(Ids) ) ':' IVal ;
Expr = Asg ( ',' Asg )* ;
Asg = Un ( '=' | AUG ) IVal | Cond | 'throw' Asg? | 'co_yield' Asg ;
Cond = Bin ( '?' Expr ':' Asg )? ;
Bin = Un ( Op Un )* ;
Op = BIN | '<' | '>' | '>' '>' | '+' | '-' | '*' | '/' | '&' | '&&' | '|' | '.*' | '->*' ;
Un = ( '+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | paren(Cast) | 'co_await' )* ( Post | 'sizeof' '...'? paren(Cast) | 'sizeof' Un | 'delete' brack(None)? Un | New | 'alignof' paren(Cast) ) ;
New = '::'? 'new' paren(Args)? Type brack(Expr)* ( paren(Args) | brace(IVals) )? ;
Cast = Type paren(Inner)? paren(Params)? ;
Post = Prim Tail* ;
Tail = '.' 'template'? ( '~'? Qual | Oper ) | '->' 'template'? ( '~'? Qual | Oper ) | brack(Args) | paren(Args) | brace(IVals) | '++' | '--' ;
Args = ( IVal '...'? ( ',' IVal '...'? )* )? | Type ;
Prim = Qual | NUM | STR+ | 'this' | 'true' | 'false' | 'nullptr' | paren(Expr) | paren(Fold) | Lambda | Prim0 | 'typename' Qual | CastK '<' Type '>' paren(Expr) | 'decltype' paren(Expr) | 'operator' | 'requires' brace(Any) | 'typeid' paren(Args) | 'noexcept' paren(Expr) | brace(IVals) ;
Fold = Expr '...' | '...' ( BIN | '+' | '*' | ',' | '&' | '|' ) Un | Un ( BIN | '+' | '*' | ',' | '&' | '|' ) '...' ( ( BIN | '+' | '*' ) Un )? ;
CastK = 'static_cast' | 'dynamic_cast' | 'reinterpret_cast' | 'const_cast' ;
Lambda = brack(Caps) Template? ( '<' TPar ( ',' TPar )* '>' )? paren(Params)? ( FTail | 'mutable' | 'constexpr' )* brace(Stmts) ;
Caps = ( Cap ( ',' Cap )* )? ;
Cap = '&' | '=' | '*'? 'this' | '&'? '...'? ID '...'? ( '=' IVal )? ;
""", ["cpp"], "File", _CLASSES, ("Stmt", "Top"))  # fmt: skip
_CPP_OPS = {BIN: ["==", "!=", "<=", ">=", "<=>", "||", "<<", "%", "^"], AUG: ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="]}
_CPP_TRIVIA = _trivia(
    r"(?P<c>//(?:\\\n|[^\n])*|/\*.*?\*/|^[ \t]*\#(?:[^\n\\\"'/]|\\\r?\n|\\.|\"(?:\\.|[^\"\\\n])*\"|/(?![/*])|'|/\*.*?\*/)*)"
    r'|(?P<s>(?:u8|[uUL])?R"(?P<d>[^(\s]{0,16})\(.*?\)(?P=d)"|(?:u8|[uUL])?' + _C_STR + r"|(?:u8|[uUL])?'(?:\\[^\n][^'\n]*|[^'\\\n]{1,4})')|(?P<k>\b0?[xXbB]?[0-9a-fA-F]+(?:'[0-9a-fA-F]+)+)|(?P<x>[\"'`]|/\*)"
)

_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b(?:[^\n\\]|\\\r?\n|\\.)*$", re.M)


def _arms(text: str, first: bool) -> str | None:
    """``text`` with the first or the last arm of each conditional; None where the directives don't match."""
    out, at, stack = [], 0, []  # of each open conditional: whether its present arm is kept

    def emit(end: int) -> None:
        part = text[at:end]
        out.append(part if all(stack) else "\n" * part.count("\n"))

    for m in _DIRECTIVE.finditer(text):
        emit(m.start())
        at = m.end()
        k = m.group(1)
        if k in ("if", "ifdef", "ifndef"):
            stack.append(first)
        elif not stack:
            return None
        elif k == "endif":
            if not first and not stack[-1]:
                stack[-1] = None  # a conditional of one arm: that arm is not taken
            stack.pop()
        else:
            stack[-1] = not first and k == "else"
    emit(len(text))
    return None if stack else "".join(out)


class _Cpp(Lexer):
    """A text is accepted with all arms of its conditionals, or else with the first arms and with the last ones, each for itself."""

    def dialects(self, text: str) -> int:
        found = super().dialects(text)
        if found or not _DIRECTIVE.search(text):
            return found
        one, other = _arms(text, True), _arms(text, False)
        return 0 if one is None or other is None else super().dialects(one) & super().dialects(other)


# --- Rust ---

RUST = Grammar("""
File = InAttr* Item* ;
Items = InAttr* Item* ;
InAttr = '#' '!' brack(Tokens) ;
Attr = '#' brack(Tokens) ;
Tokens = ( ID | NUM | STR | Kw | BIN | AUG | LIFE | '<' | '>' | '+' | '-' | '*' | '/' | '&' | '|' | '=' | '!' | '?' | '.' | ',' | ';' | ':' | '::' | '->' | '=>' | '..' | '..=' | '...' | '#' | '$' | '@' | '^' | '&&' | '||' | paren(Tokens) | brack(Tokens) | brace(Tokens) )* ;
Kw = 'as' | 'async' | 'await' | 'break' | 'const' | 'continue' | 'crate' | 'dyn' | 'else' | 'enum' | 'extern' | 'false' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'self' | 'static' | 'struct' | 'super' | 'trait' | 'true' | 'type' | 'unsafe' | 'use' | 'where' | 'while' ;
Vis = 'pub' paren(Tokens)? ;
Item = Attr* Vis? Kind ;
Kind = 'use' UseTree ';' | 'mod' ID ( ';' | brace(Items) ) | Fn ( brace(Block) | ';' ) | 'struct' ID Gen? ( Where? brace(Fields) | paren(Tuple) Where? ';' | Where? ';' ) | 'enum' ID Gen? Where? brace(Variants) | 'union' ID Gen? Where? brace(Fields)
  | 'unsafe'? 'impl' Gen? ( '!'? Type 'for' )? Type Where? brace(Items) | 'unsafe'? 'trait' ID Gen? ( ':' Bounds )? Where? brace(Items) | 'type' ID Gen? ( ':' Bounds )? Where? ( '=' Type )? Where? ';' | ( 'const' | 'static' 'mut'? ) ID ( ':' Type )? ( '=' Expr )? ';'
  | 'extern' STR? brace(Items) | 'extern' 'crate' ( ID | 'self' ) ( 'as' ID )? ';' | Path '!' ID? ( brace(Tokens) | paren(Tokens) ';' | brack(Tokens) ';' ) | 'unsafe' 'extern' STR? brace(Items) ;
UseTree = ( '::'? Seg ( '::' Seg )* ( '::' ( '*' | brace(UseTrees) ) )? ( 'as' ID )? ) | '::'? '*' | '::'? brace(UseTrees) ;
UseTrees = ( UseTree ( ',' UseTree )* ','? )? ;
Seg = ID | 'self' | 'super' | 'crate' ;
Fn = ( 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' ID Gen? paren(Params) ( '->' Type )? Where? ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Attr* ( ( '&' LIFE? )? 'mut'? 'self' ( ':' Type )? | Pat ':' Type | Type | '...' ) ;
Gen = '<' ( GPar ( ',' GPar )* ','? )? '>' ;
GPar = LIFE ( ':' LIFE ( '+' LIFE )* )? | ID ( ':' Bounds? )? ( '=' Type )? | 'const' ID ':' Type ( '=' Expr )? ;
Where = 'where' ( WPred ( ',' WPred )* ','? )? ;
WPred = ( 'for' Gen )? Type ':' Bounds? | LIFE ':' LIFE ( '+' LIFE )* ;
Bounds = Bound ( '+' Bound )* '+'? ;
Bound = LIFE | '?'? ( 'for' Gen )? Path | paren(Bound) ;
Fields = ( Field ( ',' Field )* ','? )? ;
Field = Attr* Vis? ID ':' Type ;
Tuple = ( Attr* Vis? Type ( ',' Attr* Vis? Type )* ','? )? ;
Variants = ( Variant ( ',' Variant )* ','? )? ;
Variant = Attr* ID ( paren(Tuple) | brace(Fields) )? ( '=' Expr )? ;
Type = Path | '&' LIFE? 'mut'? Type | '&&' LIFE? 'mut'? Type | '*' ( 'const' | 'mut' ) Type | paren(Tuple) | brack(TArr) | '!' | ( 'for' Gen )? ( 'unsafe' | 'extern' STR? )* 'fn' paren(Params) ( '->' Type )? | ( 'dyn' | 'impl' ) Bounds | '<' Type ( 'as' Path )? '>' '::' Path | Path '!' paren(Tokens) ;
TArr = Type ( ';' Expr )? ;
Path = '::'? PSeg ( '::' PSeg )* ;
PSeg = Seg ( '::'? Args )? | Seg paren(Tuple) ( '->' Type )? ;
Args = '<' ( GArg ( ',' GArg )* ','? )? '>' ;
GArg = Type | LIFE | ID Args? ( '=' Type | ':' Bounds ) | brace(Block) | '-'? NUM | STR ;
Block = InAttr* Stmt* Last? ;
Last = Expr ;
Stmt = ';' | Attr* Let | Item | Attr* Expr ';' | Attr* Blocky ;
Let = 'let' Pat ( ':' Type )? ( '=' Expr ( 'else' brace(Block) )? )? ';' ;
Label = LIFE ':' ;
Blocky = Label? ( 'if' | 'while' ) Cond brace(Block) Else* | 'match' NoS brace(Arms) | Label? 'for' Pat 'in' NoS brace(Block) | Label? 'loop' brace(Block) | ( 'unsafe' | 'async' 'move'? | 'const' )? brace(Block) | Label brace(Block) | Path '!' brace(Tokens) ;
Else = 'else' 'if' Cond brace(Block) | 'else' brace(Block) ;
Cond = CondP ( '&&' CondP )* ;
CondP = 'let' Pat '=' NoS | NoS ;
Arms = InAttr* ( Arm )* ;
Arm = Attr* Pat ( 'if' Cond )? '=>' ( Expr ',' | Blocky ','? ) | Attr* Pat ( 'if' Cond )? '=>' Expr ;
Pat = '|'? Pat1 ( '|' Pat1 )* ;
Pat1 = PatB ( ( '..' | '..=' | '...' ) PatB? )? | ( '..=' | '..' ) PatB? ;
PatB = 'ref'? 'mut'? ID ( '@' Pat1 )? | Path | Path paren(Pats) | Path brace(FPats) | paren(Pats) | brack(Pats) | '-'? NUM | STR | 'true' | 'false' | ( '&' | '&&' ) 'mut'? Pat1 | Path '!' paren(Tokens) ;
Pats = ( Pat ( ',' Pat )* ','? )? ;
FPats = ( FPat ( ',' FPat )* ','? )? ;
FPat = Attr* ( '..' | ( ID | NUM ) ':' Pat | 'ref'? 'mut'? ID ) ;
Expr = NoS | Struct | Bin ;
NoS = UnN ( Op UnN | 'as' Type )* | UnN ( Op UnN )* ( '=' | AUG ) Expr | Range | Jump | Closure ;
Bin = Un ( Op Un | 'as' Type )* ( ( '=' | AUG ) Expr )? ;
Range = ( UnN ( Op UnN )* )? ( '..' | '..=' ) ( UnN ( Op UnN | 'as' Type )* )? ;
Jump = 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? ;
Closure = ( 'async' | 'move' | 'static' )* ( '|' CPars '|' | '||' ) ( '->' Type brace(Block) | Expr ) ;
CPars = ( CPar ( ',' CPar )* ','? )? ;
CPar = Pat1 ( ':' Type )? ;
Op = BIN | '<' | '>' | '>' '>' | '+' | '-' | '*' | '/' | '&' | '&&' | '|' | '||' | '^' ;
Un = Pre* ( Post | Struct Tail* | Closure | Jump ) ;
UnN = Pre* ( Post | Closure | Jump ) ;
Pre = '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ( 'const' | 'mut' ) ;
Struct = EPath brace(SFields) ;
SFields = ( SField ( ',' SField )* ','? )? ;
SField = Attr* ( ( ID | NUM ) ( ':' Expr )? | '..' Expr? ) ;
EPath = '::'? ESeg ( '::' ESeg )* | '<' Type ( 'as' Path )? '>' ( '::' ESeg )+ ;
ESeg = Seg ( '::' Args )? ;
Post = Prim Tail* ;
Tail = '.' ( ID ( '::' Args )? | NUM | 'await' ) | paren(EList) | brack(Expr) | '?' ;
EList = ( Attr* Expr ( ',' Attr* Expr )* ','? )? ;
EArr = EList | Expr ';' Expr ;
Prim = EPath | EPath '!' ( paren(Tokens) | brack(Tokens) | brace(Tokens) ) | NUM | STR | 'true' | 'false' | paren(EList) | brack(EArr) | Blocky ;
""", ["rust"], "File", _CLASSES | {"LIFE": "L"}, ("Stmt", "Item", "Last"))  # fmt: skip
_RUST_OPS = {BIN: ["==", "!=", "<=", ">=", "<<", "%"], AUG: ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="]}
_RUST_ESC = r"\\(?:[nrt\\0\"']|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\})"
_RUST_TRIVIA = _trivia(
    r"(?P<c>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*\*/)"
    r'|(?P<s>(?:b|c)?r(?P<h>#*)".*?"(?P=h)|[bc]?"(?:' + _RUST_ESC + r'|\\\r?\n|[^"\\])*"|b?\'(?:' + _RUST_ESC + r'|[^\'\\\n])\')|(?P<l>\'[A-Za-z_]\w*)|(?P<x>["\'`]|/\*)'
)


class _Rust(Lexer):
    def _piece(self, m):
        return " \2 " if m.lastgroup == "l" else super()._piece(m)

    def _class(self, t):
        return "L" if t == "\2" else super()._class(t)


# --- Python ---

PYTHON = Grammar("""
File = Stmt* ;
Block = Stmt+ ;
Stmt = Small ( ';' Small )* ';'? LF | Compound ;
Suite = LF BLOCK(Block) | Small ( ';' Small )* ';'? LF ;
Id = ID | 'match' | 'case' | 'type' | '_' | @py2 'nonlocal' | @py2 'async' | @py2 'await' | 'print' | 'exec' ;
Small = Assign | 'yield' Yield | 'pass' | 'break' | 'continue' | 'return' Exprs? | 'del' Exprs | 'import' Dotteds | 'from' ( '.' | '...' )* Dotted? 'import' ( '*' | Imports | paren(Imports2) ) | 'global' Ids | @py3 'nonlocal' Ids
  | 'assert' Test ( ',' Test )? | 'raise' ( Test ( @py3 'from' Test )? ( @py2 ',' Test ( ',' Test )? )? )? | @py3 'type' Id brack(TPars)? '=' Test | @py2 'print' ( Exprs | '>' '>' Exprs )? | @py2 'exec' Bin ( 'in' Test ( ',' Test )? )? ;
Assign = Exprs | Targets ( '=' Targets )* '=' Right | Post AUG Right | Post ':' Test ( '=' Right )? ;
Right = Exprs | 'yield' Yield ;
Yield = Exprs? | @py3 'from' Test ;
Targets = Target ( ',' Target )* ','? ;
Target = '*'? Post ;
Dotteds = Dotted ( 'as' Id )? ( ',' Dotted ( 'as' Id )? )* ;
Dotted = Id ( '.' Id )* ;
Imports = Id ( 'as' Id )? ( ',' Id ( 'as' Id )? )* ;
Imports2 = Imports ','? ;
Ids = Id ( ',' Id )* ;
Compound = 'if' Named ':' Suite ( 'elif' Named ':' Suite )* Else? | 'while' Named ':' Suite Else? | @py3 'async' For | For | @py3 'async' With | With | 'try' ':' Suite ( Except+ Else? Finally? | Finally )
  | Deco* ( Def | @py3 'async' Def | Class ) | @py3 'match' Exprs ':' LF BLOCK(Cases) ;
Else = 'else' ':' Suite ;
For = 'for' Targets 'in' Exprs ':' Suite Else? ;
With = 'with' ( WItem ( ',' WItem )* | paren(WItems) ) ':' Suite ;
WItems = WItem ( ',' WItem )* ','? ;
WItem = Test ( 'as' Target )? ;
Except = 'except' ( @py3 '*' )? ( Test ( 'as' Id )? ( @py2 ',' Test )? )? ':' Suite | @py3 'except' Exprs ':' Suite ;
Finally = 'finally' ':' Suite ;
Deco = '@' Named LF ;
Def = 'def' Id ( @py3 brack(TPars) )? paren(Params) ( @py3 '->' Test )? ':' Suite ;
Class = 'class' Id ( @py3 brack(TPars) )? paren(Args)? ':' Suite ;
TPars = ( '*' | '**' )? Id ( ':' Test )? ( '=' Test )? ( ',' ( '*' | '**' )? Id ( ':' Test )? ( '=' Test )? )* ','? ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Id ( @py3 ':' Test )? ( '=' Test )? | '*' ( Id ( @py3 ':' '*'? Test )? )? | '**' Id ( @py3 ':' Test )? | @py3 '/' | @py2 paren(Targets) ( '=' Test )? ;
Cases = Case+ ;
Case = 'case' Pats ( 'if' Named )? ':' Suite ;
Pats = Pat ( ',' Pat )* ','? ;
Pat = '*'? Or ( 'as' Id )? ;
Or = Pat1 ( '|' Pat1 )* ;
Pat1 = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | Dotted paren(PArgs)? | paren(PSeq) | brack(PSeq) | brace(PMap) ;
PSeq = Pats? ;
PArgs = ( PArg ( ',' PArg )* ','? )? ;
PArg = ( Id '=' )? Pat ;
PMap = ( PItem ( ',' PItem )* ','? )? ;
PItem = Pat1 ':' Pat | '**' Id ;
Exprs = Star ( ',' Star )* ','? ;
Star = '*' Bin | Named ;
Named = Test ( @py3 ':=' Test )? ;
Test = Bin ( 'if' Bin 'else' Test )? | 'lambda' Lambda ':' Test ;
Lambda = ( LParam ( ',' LParam )* ','? )? ;
LParam = Id ( '=' Test )? | '*' Id? | '**' Id | '/' ;
Bin = Un ( Op Un )* ;
Op = BIN | '<' | '>' | '<' '>' | '>' '>' | '+' | '-' | '*' | '**' | '/' | '@' | '|' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
Un = ( 'not' | '+' | '-' | '~' | @py3 'await' )* Post ;
Post = Atom Tail* ;
Tail = '.' Id | paren(Args) | brack(Subs) ;
Args = ( Arg ( ',' Arg )* ','? )? | Named Comp ;
Arg = Named | Id '=' Test | '*' Test | '**' Test | Named Comp ;
Subs = Sub ( ',' Sub )* ','? ;
Sub = Named | '*' Test | Test? ':' Test? ( ':' Test? )? ;
Atom = Id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | paren(Paren) | brack(List) | brace(Dict) | @py2 TICK ;
Paren = Exprs? | Named Comp | 'yield' Yield ;
List = Exprs? | Named Comp ;
Comp = CompFor ( CompFor | 'if' CIf )* ;
CompFor = ( @py3 'async' )? 'for' Targets 'in' CSrc ;
CSrc = Bin ( 'if' Bin 'else' Test )? | 'lambda' Lambda ':' Test | @py2 Bin ( ',' Bin )+ ','? ;
CIf = Bin ( 'if' Bin 'else' Test )? ( @py3 ':=' Test )? | 'lambda' Lambda ':' Test ;
Dict = ( Pair ( ',' Pair )* ','? )? | Pair Comp | Exprs | Named Comp ;
Pair = Test ':' Test | '**' Bin ;
""".replace("BLOCK(Block)", "brace(Block)").replace("BLOCK(Cases)", "brace(Cases)"), ["py3", "py2"], "File", _CLASSES | {"TICK": "T"}, ("Stmt",))  # fmt: skip
_PY_OPS = {BIN: ["==", "!=", "<=", ">=", "//", "<<", "%", "&", "^"], AUG: ["+=", "-=", "*=", "/=", "//=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "@="]}
_PY_PREFIX = r"(?<![A-Za-z0-9_])(?:[rRbBuUfFtT]{1,2}(?=[\"']))?"
_PY_TRIVIA = _trivia(
    r"(?P<c>\#[^\n]*|\\\r?\n)|(?P<s>(?<![A-Za-z0-9_])(?:[rR]?[fFtT]|[fFtT][rR])(?:\"(?!\"\")(?:\\.|\{\{|\}\}|\{(?:[^{}]|\{[^{}]*\})*\}|[^\"\\\n{}])*\"|'(?!'')(?:\\.|\{\{|\}\}|\{(?:[^{}]|\{[^{}]*\})*\}|[^'\\\n{}])*')"
    r"|(?:" + _PY_PREFIX + r")?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?!\"\")(?:\\.|[^\"\\\n])*\"|'(?!'')(?:\\.|[^'\\\n])*'))|(?P<t>`[^`\n]*`)|(?P<x>[\"'`])"
)
_SPACE = re.compile(r"\s+")


class _Python(Lexer):
    """Brackets are reduced before lines are cut; indented blocks then become brace groups."""

    space = r"\n[ \t]*|\A[ \t]+"

    def _piece(self, m):
        t = m.group()
        if m.lastgroup == "c":
            return " "
        return " \2 " if m.lastgroup == "t" else STR if m.lastgroup == "s" else "\1"

    def _class(self, t):
        return "T" if t == "\2" else super()._class(t)

    def dialects(self, text: str) -> int:
        s = self.trivia.sub(self._piece, text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").replace("\f", ""))
        if "\1" in s:
            return 0
        s = "".join(map(self.__getitem__, self.split(s)))
        s = self.grammar.reduce(s, lambda x: _SPACE.sub("", x))
        if any(c in s for c in "()[]{}"):
            return 0
        out, stack = [], [0]
        for line in s.split("\n"):
            body = line.lstrip(" \t")
            if not body.strip():
                continue
            head = line[: len(line) - len(body)]
            depth = len(head.expandtabs(8))
            if depth > stack[-1]:
                stack.append(depth)
                out.append("{")
            else:
                while depth < stack[-1]:
                    stack.pop()
                    out.append("}")
                if depth != stack[-1]:
                    return 0
            out.append(_SPACE.sub("", body) + LF)
        out.append("}" * (len(stack) - 1))
        return self.grammar.accepts(self.grammar.reduce("".join(out)))


_JSON_TRIVIA = _trivia(r'(?P<s>"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*")|(?P<x>["\'`])')
LEXERS: dict[str, tuple[Lexer, int]] = {}


def _register() -> None:
    js = _Js(JS, _JS_TRIVIA, _JS_OPS, _js_lines(JS))
    LEXERS.update(
        json=(_Json(JSON, _JSON_TRIVIA, {}), 1),
        javascript=(js, JS.dialects["js"]),
        typescript=(js, JS.dialects["ts"]),
        go=(Lexer(GO, _GO_TRIVIA, _GO_OPS, _go_lines(GO)), 1),
        java=(Lexer(JAVA, _JAVA_TRIVIA, _JAVA_OPS), JAVA.all),
        cpp=(_Cpp(CPP, _CPP_TRIVIA, _CPP_OPS), 1),
        rust=(_Rust(RUST, _RUST_TRIVIA, _RUST_OPS), 1),
        python=(_Python(PYTHON, _PY_TRIVIA, _PY_OPS), PYTHON.all),
    )


_register()
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "cpp": "cpp", "hpp": "cpp", "h": "cpp", "cc": "cpp", "rs": "rust", "json": "json"}


def parses(text: str, language: str) -> bool:
    """Whether a supported dialect of the language has the whole text as a sentence; True for other languages."""
    entry = LEXERS.get(language)
    return True if entry is None else bool(entry[0].dialects(text) & entry[1])
