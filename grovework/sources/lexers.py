"""Token streams of five languages: (token classes, line break before, offset, text), without comments.

A token that is none has the class BAD.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterator

Token = tuple[tuple, bool, int, str]
BAD = ("BAD",)

#: Words of the languages.
PY_SOFT = {"match", "case", "type", "_"}
ES_RESERVED = set(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if "
    "implements import in instanceof interface let new null package private protected public return static super switch this throw true try "
    "typeof var void while with yield".split()
)
ES_CONTEXT = set(
    "as async from get set of type declare namespace module abstract readonly is keyof infer satisfies asserts unique override accessor out "
    "global require".split()
)
GO_WORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct "
    "switch type var".split()
)
RUST_WORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self "
    "static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
RUST_CONTEXT = {"union", "auto", "raw"}

_PY_AUG = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}


class Broken(Exception):
    """A token that cannot be read; ``cut`` when the input ends within it."""

    def __init__(self, at: int, what: str, cut: bool = False) -> None:
        super().__init__(what)
        self.at, self.what, self.cut = at, what, cut


def python_tokens(text: str) -> Iterator[Token]:
    if "\0" in text:
        raise Broken(text.index("\0"), "NUL")
    starts = [0]
    for line in text.splitlines(keepends=True) if "\f" not in text and "\x0b" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        starts.append(starts[-1] + len(line))
    at = lambda p: starts[min(p[0] - 1, len(starts) - 1)] + p[1]
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind, s = t.type, t.string
            if kind in (tokenize.COMMENT, tokenize.NL):
                continue
            if kind == tokenize.NAME:
                c = (s, "ID") if s in PY_SOFT else (s,) if keyword.iskeyword(s) else ("ID",)
            elif kind == tokenize.OP:
                c = ("AUG",) if s in _PY_AUG else (s,)
            elif kind == tokenize.NUMBER:
                c = ("NUMBER",)
            elif kind == tokenize.STRING:
                c = ("STRING",)
            elif kind == tokenize.ENDMARKER:
                continue
            else:
                name = tokenize.tok_name[kind]
                c = (name.replace("FSTRING_", "F") if name.startswith("FSTRING_") else name,)
                c = BAD if c == ("ERRORTOKEN",) else c
            yield c, False, at(t.start), s
    except tokenize.TokenError as e:
        line = e.args[1][0] if len(e.args) > 1 else 1
        raise Broken(starts[min(line - 1, len(starts) - 1)], str(e.args[0]), "EOF" in str(e.args[0])) from None
    except SyntaxError as e:
        raise Broken(starts[min((e.lineno or 1) - 1, len(starts) - 1)], str(e.msg)) from None


_ES_SPACE = re.compile(r"(?:[ \t\v\f ﻿  -   　\r\n  ]+|//[^\r\n  ]*|/\*[\s\S]*?\*/)+")
_ES_TOKEN = re.compile(
    r"(?P<word>\#?(?:[A-Za-z_$\u0080-\U0010ffff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$‌‍\u0080-\U0010ffff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)"
    r"|(?P<num>0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$])"
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<op>\.\.\.|=>|\?\.(?!\d)|===|!==|==|!=|\*\*=|<<=|&&=|\|\|=|\?\?=|\*\*|<<|<=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*%&|^!~?:=.@])"
)
_ES_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_ES_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_ES_ASSIGN = {"+=", "-=", "*=", "**=", "/=", "%=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="}
_ES_BINARY = {"%", "**", "<<", "<=", "==", "===", "!=", "!==", "&&", "||", "??", "^"}


def ecma_tokens(text: str, accepts: Callable[[tuple], bool], start: int = 0) -> Iterator[Token]:
    """``accepts`` tells whether the parser, as it stands, takes a token class: it settles division against regex."""
    at = text.index("\n") if text.startswith("#!") and "\n" in text and not start else start
    n, depth, templates = len(text), 0, []
    while True:
        fresh = False
        m = _ES_SPACE.match(text, at)
        if m:
            fresh = any(ch in m.group() for ch in "\n\r  ")
            at = m.end()
        if at >= n:
            if templates:
                raise Broken(n, "template", True)
            return
        ch = text[at]
        if ch == "`" or (ch == "}" and templates and templates[-1] == depth):
            m = _ES_TEMPLATE.match(text, at + 1)
            end = m.end()
            if end >= n:
                raise Broken(at, "template", True)
            if text[end] == "`":
                c = ("TEMPLATE",) if ch == "`" else ("TTAIL",)
                if ch == "}":
                    templates.pop()
                stop = end + 1
            else:
                c = ("THEAD",) if ch == "`" else ("TMIDDLE",)
                if ch == "`":
                    templates.append(depth)
                stop = end + 2
            yield c, fresh, at, text[at:stop]
            at = stop
            continue
        if ch == "/":
            if text.startswith("/*", at):
                raise Broken(at, "comment", True)
            if accepts(("/", "BINOP")):
                stop = at + (2 if text.startswith("/=", at) else 1)
                yield ("ASSIGN",) if stop == at + 2 else ("/",), fresh, at, text[at:stop]
            else:
                m = _ES_REGEX.match(text, at)
                if not m:
                    raise Broken(at, "regular expression")
                stop = m.end()
                yield ("REGEX",), fresh, at, m.group()
            at = stop
            continue
        m = _ES_TOKEN.match(text, at)
        if not m:
            cut = ch in "\"'" and "\n" not in text[at:]
            raise Broken(at, ch, cut)
        s, kind = m.group(), m.lastgroup
        if kind == "word":
            if s[0] == "#":
                c = ("PRIVATE",)
            elif s in ES_RESERVED:
                c = (s, "NAME")
            else:
                c = (s, "ID", "NAME") if s in ES_CONTEXT else ("ID", "NAME")
        elif kind == "num":
            c = ("NUMBER",)
        elif kind == "str":
            c = ("STRING",)
        else:
            if s == "{":
                depth += 1
            elif s == "}":
                depth -= 1
            c = ("ASSIGN",) if s in _ES_ASSIGN else ("BINOP",) if s in _ES_BINARY else (s, "BINOP") if s in "&|" else (s,)
        yield c, fresh, at, s
        at = m.end()


_GO_SPACE = re.compile(r"(?:[ \t\r\n]+|//[^\n]*|/\*[\s\S]*?\*/)+")
_GO_TOKEN = re.compile(
    r"(?P<word>[^\W\d]\w*)"
    r"|(?P<num>(?:0[xX](?:_?[\da-fA-F])+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?)i?)(?!\w)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\[^\n][^'\n]*)')"
    r"|(?P<op>\.\.\.|<<=|>>=|&\^=|&\^|<<|>>|<-|:=|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~:=.])"
)
_GO_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}
_GO_BINARY = {"/", "%", "<<", ">>", "&^", "&&", "||", "==", "!=", "<", "<=", ">", ">="}
_GO_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def go_tokens(text: str, start: int = 0) -> Iterator[Token]:
    at, n, ends = max(start, 1 if text.startswith("﻿") else 0), len(text), False
    while True:
        fresh = False
        m = _GO_SPACE.match(text, at)
        if m:
            fresh = "\n" in m.group()
            at = m.end()
        if ends and (fresh or at >= n):
            yield (";",), False, at, "\n"
        if at >= n:
            return
        m = _GO_TOKEN.match(text, at)
        if not m:
            ch = text[at]
            raise Broken(at, ch, text.startswith("/*", at) or ch == "`" or (ch in "\"'" and "\n" not in text[at:]))
        s, kind = m.group(), m.lastgroup
        if kind == "word":
            c = (s,) if s in GO_WORDS else ("ID",)
        elif kind == "op":
            c = ("ASSIGN",) if s in _GO_ASSIGN else ("BINOP",) if s in _GO_BINARY else ("BINOP", s) if s in "+-^&" else (s,)
        else:
            c = ({"num": "NUMBER", "str": "STRING", "char": "CHAR"}[kind],)
        ends = (kind != "op" and not (kind == "word" and s in GO_WORDS)) or s in _GO_ENDS
        yield c, fresh, at, s
        at = m.end()


_RUST_SPACE = re.compile(r"(?:\s+|//[^\n]*)+")
_RUST_TOKEN = re.compile(
    r"(?P<str>(?:[bc]?\"(?:[^\"\\]|\\[\s\S])*\")|(?:[bc]?r(?P<hash>\#*)\"[\s\S]*?\"(?P=hash)))"
    r"|(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[^\n]))')"
    r"|(?P<life>'(?:[^\W\d])\w*)"
    r"|(?P<word>(?:r\#)?[^\W\d]\w*)"
    r"|(?P<num>0[xX][\da-fA-F_]+\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|\d[\d_]*(?:\.(?![._A-Za-z])[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)"
    r"|(?P<op>\.\.=|\.\.\.|\.\.|::|->|=>|<<=|&&|\|\||==|!=|<=|<<|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[{}()\[\];,<>+\-*/%&|^!:=.@?\#$~])"
)
_RUST_BINARY = {"/", "%", "^", "<<", "==", "!=", "<=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<="}


def rust_tokens(text: str, start: int = 0) -> Iterator[Token]:
    at, n = max(start, 1 if text.startswith("﻿") else 0), len(text)
    if text.startswith("#!") and not text.startswith("#![") and not start:
        at = text.index("\n") if "\n" in text else n
    while True:
        while at < n:
            m = _RUST_SPACE.match(text, at)
            if m:
                at = m.end()
            elif text.startswith("/*", at):
                depth, start = 1, at
                at += 2
                while depth:
                    m = re.compile(r"/\*|\*/").search(text, at)
                    if not m:
                        raise Broken(start, "comment", True)
                    depth += 1 if m.group() == "/*" else -1
                    at = m.end()
            else:
                break
        if at >= n:
            return
        m = _RUST_TOKEN.match(text, at)
        if not m:
            raise Broken(at, text[at], text[at] == '"')
        s, kind = m.group(), m.lastgroup
        kind = "str" if kind == "hash" else kind
        if kind == "word":
            c = ("_", "ANY") if s == "_" else (s, "ANY") if s in RUST_WORDS else (s, "ID", "ANY") if s in RUST_CONTEXT else ("ID", "ANY")
        elif kind == "op":
            if s in "{}()[]":
                c = (s,)
            else:
                c = ("RANGE", "ANY") if s in ("..", "..=") else ("BINOP", "ANY") if s in _RUST_BINARY else (s, "ANY")
        else:
            c = ({"num": "NUMBER", "str": "STRING", "char": "CHAR", "life": "LIFE"}[kind], "ANY")
        yield c, False, at, s
        at = m.end()
