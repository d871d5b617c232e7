"""Scanner of Go source, by the public language specification: tokens with semicolons inserted."""

from __future__ import annotations

import re
import unicodedata


class SyntaxFault(Exception):
    """The source is not Go; the whole file is refused."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.message, self.at = message, at


KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
#: Kinds behind which the end of a line is a semicolon.
ENDS = frozenset(["IDENT", "INT", "FLOAT", "IMAG", "CHAR", "STRING", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])

_DIGITS = r"[0-9](?:_?[0-9])*"
_ESCAPE = r"\\(?:[abfnrtv\\{q}]|[0-3][0-7]{{2}}|x[0-9a-fA-F]{{2}}|u(?![dD][89a-fA-F])[0-9a-fA-F]{{4}}|U00(?:10|0[0-9a-fA-F])(?!(?<=U0000)[dD][89a-fA-F])[0-9a-fA-F]{{4}})"
#: The commonest kinds come first; blanks before a token are part of its match.
_TOKEN = re.compile(
    rf"""[ \t\r]*(?:
    (?P<IDENT>[^\W\d]\w*)
  | (?P<operator>[()\[\]{{}},;~]|:=?|==?|\.\.\.|\.(?![0-9])|\*=?|%=?|!=?|\^=?|\+[+=]?|-[-=]?|<<=?|<[-=]?|>>=?|>=?|&\^=?|&[&=]?|\|[|=]?|/(?![/*])=?)
  | (?P<line>\n)
  | (?P<number>
        0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?{_DIGITS})?
      | 0[bB](?:_?[01])+ | 0[oO](?:_?[0-7])+
      | (?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?
    )
  | (?P<STRING>"(?:[^"\\\n]|{_ESCAPE.format(q='"')})*"|`[^`]*`)
  | (?P<CHAR>'(?:[^'\\\n]|{_ESCAPE.format(q="'")})')
  | (?P<comment>//[^\n]*|/\*.*?\*/)
  | (?P<end>\Z)
    )""",
    re.VERBOSE | re.DOTALL,
)
_HEX = re.compile(r"0[xX](?P<whole>(?:_?[0-9a-fA-F])*)(?P<point>\.(?P<part>[0-9a-fA-F_]*))?(?P<power>[pP].*)?")


def _number(text: str, imaginary: bool, at: int) -> str:
    """The kind of a number literal."""
    if text[:2] in ("0x", "0X"):
        m = _HEX.fullmatch(text)
        if not m["whole"] and not m["part"]:
            raise SyntaxFault("hexadecimal literal has no digits", at)
        if m["point"] and not m["power"]:
            raise SyntaxFault("hexadecimal mantissa requires a 'p' exponent", at)
        kind = "FLOAT" if m["power"] else "INT"
    elif text[:2] in ("0b", "0B", "0o", "0O"):
        kind = "INT"
    else:
        kind = "FLOAT" if set(text) & set(".eE") else "INT"
        if kind == "INT" and not imaginary and text[0] == "0" and set(text) & set("89"):
            raise SyntaxFault("invalid digit in octal literal", at)
    return "IMAG" if imaginary else kind


def _is_name(text: str) -> bool:
    """Whether a run of word characters is a name: letters, decimal digits and _ only."""
    return text.isascii() or all(c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" for c in text)


def scan(source: str) -> list[tuple[str, str, int]]:
    """Tokens (kind, text, offset): keywords and operators are their own kind; an inserted semicolon
    has the text of a line end; the last token is EOF."""
    if "\0" in source or "﻿" in source[1:]:
        raise SyntaxFault("illegal NUL or byte order mark", max(source.find("\0"), source.find("﻿", 1)))
    out: list[tuple[str, str, int]] = []
    add, at, ends = out.append, int(source[:1] == "﻿"), False
    step = _TOKEN.scanner(source, at).match
    while (m := step()) is not None:
        kind = m.lastgroup
        start, stop = m.span(kind)
        text = source[start:stop]
        if kind == "IDENT":
            if text in KEYWORDS:
                kind = text
            elif not _is_name(text):
                raise SyntaxFault("illegal character in a name", start)
            add((kind, text, start))
            ends = kind in ENDS
        elif kind == "operator":
            add((text, text, start))
            ends = text in ENDS
        elif kind == "line" or kind == "comment" and text[1] == "*" and "\n" in text:
            if ends:
                add((";", "\n", start))
            ends = False
        elif kind == "number":
            imaginary = source[stop : stop + 1] == "i"
            kind = _number(text, imaginary, start)
            stop += imaginary
            if stop < len(source) and (source[stop].isalnum() or source[stop] == "_"):
                raise SyntaxFault("invalid number literal", start)
            add((kind, source[start:stop], start))
            ends = True
            step = _TOKEN.scanner(source, stop).match if imaginary else step
        elif kind == "end":
            break
        elif kind != "comment":
            add((kind, text, start))
            ends = True
        at = stop
    else:
        at += len(source[at:]) - len(source[at:].lstrip(" \t\r"))
        raise SyntaxFault(f"illegal character {source[at]!r}", at)
    if ends:
        add((";", "\n", len(source)))
    add(("EOF", "", len(source)))
    return out
