"""Rules over JavaScript and TypeScript source, on the tokens of a file.

There is no grammar here: a lexer knows strings, template literals with nested
substitutions, regular expressions and comments, and rules match on the token
stream. Operands of ``==`` are found by operator precedence. JSX text is lexed as
code. A file with unbalanced brackets or an unterminated literal counts as broken
and its findings have confidence ``possible``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

Found = tuple[str, int, int, int, int]


@dataclass
class Token:
    kind: str  # word, number, string, template, regex, comment or mark
    text: str
    start: int
    end: int
    #: For a template: whether it has a substitution.
    filled: bool = False


_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010FFFF#@][\w$\u0080-\U0010FFFF]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[\s\S]")
#: After these words a slash opens a regular expression, and no operand has ended.
_PREFIX_WORDS = frozenset("return typeof case do else in of instanceof new delete void throw yield await".split())
#: Words and marks that end an operand of ``==`` to either side.
_STOP_WORDS = frozenset("return case do else throw yield of default var let const export import if while for switch with async".split())
_LOWER = frozenset("&& || ?? ? : = => += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= & ^ | , ; { } ...".split())
_EQUALITY = frozenset(("==", "!=", "===", "!=="))
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def lex(source: str) -> tuple[list[Token], bool]:
    """(tokens, broken)."""
    out: list[Token] = []
    broken, i, n = False, 0, len(source)

    def value_ended() -> bool:
        last = next((t for t in reversed(out) if t.kind != "comment"), None)
        if last is None:
            return False
        if last.kind == "word":
            return last.text not in _PREFIX_WORDS
        return last.kind in ("number", "string", "template", "regex") or last.text in (")", "]", "}")

    while i < n:
        c = source[i]
        if c.isspace() or c == "﻿":
            i += 1
        elif source.startswith("//", i) or source.startswith("#!", i) and not i:
            j = source.find("\n", i)
            j = n if j < 0 else j
            out.append(Token("comment", source[i:j], i, j))
            i = j
        elif source.startswith("/*", i):
            j = source.find("*/", i + 2)
            broken |= j < 0
            j = n if j < 0 else j + 2
            out.append(Token("comment", source[i:j], i, j))
            i = j
        elif c in "'\"":
            j = i + 1
            while j < n and source[j] not in (c, "\n"):
                j += 2 if source[j] == "\\" else 1
            broken |= j >= n or source[j] != c
            j = min(j + 1, n)
            out.append(Token("string", source[i:j], i, j))
            i = j
        elif c == "`":
            j, filled, inner = _template(source, i)
            broken |= j > n
            j = min(j, n)
            out.append(Token("template", source[i:j], i, j, filled))
            i = j
        elif c == "/" and not value_ended() and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*").match(source, i)):
            out.append(Token("regex", m[0], i, m.end()))
            i = m.end()
        elif m := _NUMBER.match(source, i) if c.isdigit() or c == "." and source[i + 1 : i + 2].isdigit() else None:
            out.append(Token("number", m[0], i, m.end()))
            i = m.end()
        elif m := _WORD.match(source, i):
            out.append(Token("word", m[0], i, m.end()))
            i = m.end()
        else:
            m = _MARK.match(source, i)
            out.append(Token("mark", m[0], i, m.end()))
            i = m.end()
    return out, broken


def _template(source: str, i: int) -> tuple[int, bool, list[tuple[int, int]]]:
    """(end, has a substitution, ranges of substituted code) of a template literal; the end is beyond the source if it is not closed."""
    j, filled, inner = i + 1, False, []
    while j < len(source):
        if source[j] == "\\":
            j += 2
        elif source[j] == "`":
            return j + 1, filled, inner
        elif source.startswith("${", j):
            filled, begin, depth = True, j + 2, 1
            j += 2
            while j < len(source) and depth:
                c = source[j]
                if c == "`":
                    j = _template(source, j)[0]
                    continue
                if c in "'\"":
                    j += 1
                    while j < len(source) and source[j] not in (c, "\n"):
                        j += 2 if source[j] == "\\" else 1
                depth += (c == "{") - (c == "}")
                j += 1
            inner.append((begin, j - 1))
        else:
            j += 1
    return len(source) + 1, filled, inner


def _partners(tokens: list[Token]) -> tuple[dict[int, int], bool]:
    """Opening to closing bracket and back; whether all fit."""
    pairs, stack, fits = {}, [], True
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            if stack and tokens[stack[-1]].text == _CLOSE[t.text]:
                pairs[i] = stack[-1]
                pairs[stack.pop()] = i
            else:
                fits = False
    return pairs, fits and not stack


def _ends_value(t: Token) -> bool:
    return t.kind in ("number", "string", "template", "regex") or t.kind == "word" and t.text not in _PREFIX_WORDS or t.text in (")", "]", "}", "++", "--")


def _left(tokens: list[Token], pairs: dict[int, int], op: int) -> int:
    """Index of the first token of the left operand."""
    i = op
    while i > 0:
        t = tokens[i - 1]
        if t.kind == "mark" and t.text in _CLOSE and t.text != "}" and i - 1 in pairs:
            j = pairs[i - 1]
        elif t.kind == "mark" and (t.text in _LOWER or t.text in _OPEN or t.text in _CLOSE) or t.kind == "word" and t.text in _STOP_WORDS:
            break
        else:
            j = i - 1
        # Two values in a row with nothing between them are two statements, unless the second continues the first.
        if i < op and _ends_value(t) and (tokens[i].kind in ("word", "number", "string", "regex") and tokens[i].text not in ("in", "instanceof", "as") or tokens[i].text == "!"):
            break
        i = j
    return i


def _right(tokens: list[Token], pairs: dict[int, int], op: int) -> int:
    """Index after the last token of the right operand."""
    i = op + 1
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "mark" and t.text in _OPEN and i in pairs and not (t.text == "{" and i > op + 1):
            j = pairs[i] + 1
        elif t.kind == "mark" and (t.text in _LOWER or t.text in _EQUALITY or t.text in _OPEN or t.text in _CLOSE) or t.kind == "word" and t.text in _STOP_WORDS:
            break
        else:
            j = i + 1
        if i > op + 1 and _ends_value(tokens[i - 1]) and t.kind in ("word", "number", "string", "regex") and t.text not in ("in", "instanceof", "as"):
            break
        i = j
    return i


def _matches(tokens: list[Token], comments: list[Token], pairs: dict[int, int]) -> Iterator[tuple[str, int, int]]:
    text = lambda i: tokens[i].text if 0 <= i < len(tokens) and tokens[i].kind in ("word", "mark") else None
    starts = [c.start for c in comments]
    for i, t in enumerate(tokens):
        if t.kind not in ("word", "mark"):
            continue
        member = text(i - 1) in (".", "?.")
        if t.text == "console" and not member and text(i + 1) == "." and text(i + 2) == "log" and text(i + 3) == "(":
            yield "javascript.console-log", t.start, tokens[i + 2].end
        elif t.text == "eval" and not member and text(i + 1) == "(" and text(i - 1) not in ("function", "new") and i + 1 in pairs:
            yield "javascript.dangerous-eval", t.start, tokens[pairs[i + 1]].end
        elif t.text == "new" and not member and text(i + 1) == "Function" and text(i + 2) != ".":
            end = pairs.get(i + 2, i + 1) if text(i + 2) == "(" else i + 1
            yield "javascript.dangerous-eval", t.start, tokens[end].end
        elif t.text in ("query", "execute") and member and text(i + 1) == "(" and i + 1 in pairs:
            for k in range(i + 2, pairs[i + 1]):
                alone = text(k - 1) in ("(", ",") and (k - 1 == i + 1 or text(k - 1) == ",") and text(k + 1) in (")", ",")
                if tokens[k].kind == "template" and tokens[k].filled and alone and _depth_is_one(tokens, pairs, i + 1, k):
                    yield "javascript.sql-injection", tokens[k].start, tokens[k].end
        elif t.text == "catch" and not member:
            body = pairs.get(i + 1, i) + 1 if text(i + 1) == "(" else i + 1
            if text(body) == "{" and text(body + 1) == "}":
                inside = bisect_right(starts, tokens[body].start)
                if inside == len(starts) or starts[inside] > tokens[body + 1].start:
                    yield "javascript.empty-catch-block", t.start, tokens[body + 1].end
        elif t.text in ("==", "!=") and t.kind == "mark":
            a, b = _left(tokens, pairs, i), _right(tokens, pairs, i)
            if a < i and b > i + 1 and not (i - a == 1 and text(a) == "null") and not (b - i == 2 and text(i + 1) == "null"):
                yield "javascript.loose-equality", tokens[a].start, tokens[b - 1].end


def _depth_is_one(tokens: list[Token], pairs: dict[int, int], opened: int, k: int) -> bool:
    i = opened + 1
    while i < k:
        i = pairs[i] + 1 if tokens[i].kind == "mark" and tokens[i].text in _OPEN and i in pairs else i + 1
    return i == k


def _spans(source: str, offset: int = 0) -> tuple[list[tuple[str, int, int]], bool]:
    """Matches in the code and in the code inside template literals; whether it is broken."""
    every, broken = lex(source)
    comments, tokens = [t for t in every if t.kind == "comment"], [t for t in every if t.kind != "comment"]
    pairs, fits = _partners(tokens)
    out = [(r, a + offset, b + offset) for r, a, b in _matches(tokens, comments, pairs)]
    for t in tokens:
        if t.filled:
            for a, b in _template(source, t.start)[2]:
                out += _spans(source[a:b], offset + a)[0]
    return out, broken or not fits


def analyze_script(content: str) -> tuple[list[Found], str]:
    """(findings, confidence) of a file."""
    spans, broken = _spans(content)
    lines = [0, *[m.end() for m in re.finditer("\n", content)]]

    def point(i: int) -> tuple[int, int]:
        k = bisect_right(lines, i) - 1
        return k + 1, len(content[lines[k] : i].encode("utf-8", "surrogatepass")) + 1

    return sorted((r, *point(a), *point(b)) for r, a, b in spans), "possible" if broken else "likely"
