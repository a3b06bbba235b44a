"""Rules over Python source, in one parse of a file.

Positions are 1-based lines and 1-based UTF-8 byte columns, the end exclusive.
A file that does not parse is matched by its text instead, with confidence
``possible``. Comments are no nodes here, so a bare ``except`` with a comment in
it is reported as well.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Iterator

Found = tuple[str, int, int, int, int]
_STRING_OPENS = {tokenize.STRING, getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "TSTRING_START", -1)}


def _at(rule: str, start: ast.AST, end: ast.AST) -> Found:
    return rule, start.lineno, start.col_offset + 1, end.end_lineno, end.end_col_offset + 1


def _is_one_literal(source: str, node: ast.AST) -> bool:
    """Adjacent literals are joined by the parser but are not one string to look at."""
    text = ast.get_source_segment(source, node)
    depth = opens = 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(f"({text})").readline):
            if t.type in _STRING_OPENS and not depth:
                opens += 1
            depth += tokenize.tok_name[t.type].endswith("STRING_START") - tokenize.tok_name[t.type].endswith("STRING_END")
    except (tokenize.TokenError, SyntaxError):
        return True
    return opens == 1


def _builds_sql(source: str, arg: ast.expr) -> bool:
    if isinstance(arg, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in arg.values) and _is_one_literal(source, arg)
    if isinstance(arg, ast.BinOp) and isinstance(arg.op, ast.Mod):
        text = isinstance(arg.left, ast.JoinedStr) or isinstance(arg.left, ast.Constant) and isinstance(arg.left.value, str)
        return text and _is_one_literal(source, arg.left)
    return False


def _of_call(source: str, node: ast.Call) -> Iterator[Found]:
    f = node.func
    if isinstance(f, ast.Name) and f.id in ("eval", "exec"):
        yield _at("python.dangerous-eval", node, node)
    if isinstance(f, ast.Name) and f.id == "breakpoint":
        yield _at("python.debug-artifact", node, node)
    if isinstance(f, ast.Attribute):
        if f.attr == "set_trace" and isinstance(f.value, ast.Name) and f.value.id == "pdb":
            yield _at("python.debug-artifact", node, node)
        if f.attr in ("execute", "executemany"):
            yield from (_at("python.sql-injection", a, a) for a in node.args if _builds_sql(source, a))


def _of_arguments(args: ast.arguments) -> Iterator[Found]:
    plain = [*args.posonlyargs, *args.args]
    pairs = [*zip(plain[len(plain) - len(args.defaults) :], args.defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    for arg, default in pairs:
        if arg.annotation is None and isinstance(default, (ast.List, ast.Dict, ast.Set)):
            yield _at("python.mutable-default-argument", arg, default)


def _by_text(content: str) -> Iterator[Found]:
    """What can be told from the text of a file that does not parse."""
    blank = re.sub(r"'''.*?'''|\"\"\".*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|#[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)

    starts = [0, *(m.end() for m in re.finditer("\n", content))]

    def place(rule: str, a: int, b: int) -> Found:
        def point(i: int) -> tuple[int, int]:
            line = bisect.bisect_right(starts, i)
            return line, len(content[starts[line - 1] : i].encode("utf-8", "surrogatepass")) + 1

        return rule, *point(a), *point(b)

    def close(i: int) -> int:
        depth = 0
        for k in range(i, len(blank)):
            depth += (blank[k] == "(") - (blank[k] == ")")
            if not depth:
                return k + 1
        return len(content)

    for m in re.finditer(r"(?<![\w.])(eval|exec|breakpoint|pdb\.set_trace)\s*\(", blank):
        rule = "python.dangerous-eval" if m[1] in ("eval", "exec") else "python.debug-artifact"
        yield place(rule, m.start(), close(m.end() - 1))
    for m in re.finditer(r"(?<!\w)except\s*:", blank):
        yield place("python.bare-except", m.start(), m.end())


def analyze_python(content: str) -> tuple[list[Found], str]:
    """(findings, confidence) of a file."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return sorted(_by_text(content)), "possible"
    out: list[Found] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            out += _of_call(content, node)
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            out.append(_at("python.bare-except", node, node))
        elif isinstance(node, ast.arguments):
            out += _of_arguments(node)
    return sorted(out), "likely"
