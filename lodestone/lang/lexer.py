"""Tokens of the language."""

from __future__ import annotations

import re
from dataclasses import dataclass

_ESCAPES = {"0": "\0", "n": "\n", "f": "\f", "r": "\r", "t": "\t", "v": "\v", "b": "\b"}
_SELF_WORDS = ("self", "ctx", "event", "auto", "old")
_NUMBER = re.compile(r"(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?")
_IDENT = re.compile(r"[^\W\d]\w*")
_HEX = re.compile(r"[0-9A-Fa-f]+")
_PUNCT = (">>>=", "<<=", ">>=", ">>>", "||=", "->", "<<", ">>", "<=", ">=", "<>", "!=", "||", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@{", "@[", "@:", "$(", "${", *"+-*/%&|^~<>=(){}[],.;:@?$#")


class SyntaxProblem(ValueError):
    """The text is not a statement of the language."""


@dataclass(frozen=True)
class Token:
    """``kind``: word, name (quoted or qualified), string, number, hex, pid, object, param, regex, op, end."""

    kind: str
    value: object
    at: int
    extra: object = None

    @property
    def upper(self) -> str:
        return str(self.value).upper()


def _string(text: str, at: int) -> tuple[str, int]:
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == quote:
            if text[i + 1 : i + 2] == quote:
                out.append(quote)
                i += 2
                continue
            return "".join(out), i + 1
        if c == "\\" and i + 1 < len(text):
            e = text[i + 1]
            out.append(_ESCAPES.get(e, e))
            i += 2
            continue
        out.append(c)
        i += 1
    raise SyntaxProblem(f"a quoted text that begins at {at} has no end")


def _skip(text: str, i: int) -> int:
    """The place after white space and comments; ``/* */`` nests."""
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end + 1
        elif text.startswith("/*", i):
            depth, i = 1, i + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, i)
                if not m:
                    raise SyntaxProblem("a comment has no end")
                depth += 1 if m.group() == "/*" else -1
                i = m.end()
        else:
            break
    return i


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    i = _skip(text, 0)
    while i < len(text):
        c = text[i]
        start = i
        after_similar = out and out[-1].kind == "word" and (out[-1].upper == "TO" and len(out) > 1 and out[-2].upper == "SIMILAR" or out[-1].upper == "SIMILAR")
        if after_similar and c == "/":
            j = i + 1
            while j < len(text) and text[j] != "/":
                j += 2 if text[j] == "\\" else 1
            body = text[i + 1 : j]
            m = re.compile(r"[gim]*").match(text, j + 1)
            out.append(Token("regex", body, start, m.group()))
            i = m.end()
        elif c == "'":
            s, i = _string(text, i)
            out.append(Token("string", s, start))
        elif c in "xX" and text[i + 1 : i + 2] == "'":
            s, i = _string(text, i + 1)
            out.append(Token("hex", bytes.fromhex(s), start))
        elif c == '"':
            s, i = _string(text, i)
            out.append(Token("name", s, start))
        elif m := _IDENT.match(text, i):
            word, i = m.group(), m.end()
            if text[i : i + 1] == ":" and (m := _IDENT.match(text, i + 1)) and not (out and out[-1].value in ("[", "?")):
                out.append(Token("name", m.group(), start, word))
                i = m.end()
            else:
                out.append(Token("word", word, start))
        elif c.isdigit() or c == "." and text[i + 1 : i + 2].isdigit():
            m = _NUMBER.match(text, i)
            i = m.end()
            digits, unit = m.group(), None
            if m := _IDENT.match(text, i):
                unit, i = m.group(), m.end()
                if text[i : i + 1] == "/" and (m := re.compile(r"/(?:s2|s|h|m3|m)\b").match(text, i)):
                    unit, i = unit + m.group(), m.end()
            number = float(digits) if re.search(r"[.eE]", digits) or unit not in (None, "u", "U") else int(digits)
            out.append(Token("number", number, start, None if unit in ("u", "U", "f") else unit))
        elif c == "@" and (m := _IDENT.match(text, i + 1)) and m.group().lower() in _SELF_WORDS:
            out.append(Token("self", m.group().lower(), start))
            i = m.end()
        elif c == "@" and (m := _HEX.match(text, i + 1)):
            i, who = m.end(), None
            if text[i : i + 1] == "!" and (w := _HEX.match(text, i + 1)):
                who, i = int(w.group(), 16), w.end()
            out.append(Token("pid", int(m.group(), 16), start, who))
        elif c == "#" and (m := _IDENT.match(text, i + 1)):
            out.append(Token("object", m.group(), start))
            i = m.end()
        elif c == ":" and (m := re.compile(r"\d+|[^\W\d]\w*").match(text, i + 1)):
            out.append(Token("param", int(m.group()) if m.group().isdigit() else m.group(), start))
            i = m.end()
        else:
            for p in _PUNCT:
                if text.startswith(p, i):
                    out.append(Token("op", p, start))
                    i += len(p)
                    break
            else:
                raise SyntaxProblem(f"unexpected {c!r} at {i}")
        i = _skip(text, i)
    out.append(Token("end", "", len(text)))
    return out
