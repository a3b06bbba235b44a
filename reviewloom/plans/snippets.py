"""Source snippets with the findings they are known to have: the view that analyzer queries run on."""

from __future__ import annotations

_PY, _JS = "python", "javascript"

#: name: (language, content, [(rule, start line, start column, end line, end column)], confidence).
SNIPPETS = {
    "P1": (_PY, "x = 1\neval(x)\n", [("python.dangerous-eval", 2, 1, 2, 8)], "likely"),
    "P2": (_PY, "s = 'é'; exec(s)\n", [("python.dangerous-eval", 1, 11, 1, 18)], "likely"),
    "P3": (_PY, "try:\n    go()\nexcept:\n    pass\n", [("python.bare-except", 3, 1, 4, 9)], "likely"),
    "P4": (_PY, "try:\n    go()\nexcept OSError:\n    pass\n", [], "likely"),
    "P5": (_PY, "def f(a=[], b={}, c=1):\n    return a\n", [("python.mutable-default-argument", 1, 7, 1, 11), ("python.mutable-default-argument", 1, 13, 1, 17)], "likely"),
    "P6": (_PY, "def f(a: list = []):\n    return a\n", [], "likely"),
    "P7": (_PY, 'cur.execute(f"select {x}")\n', [("python.sql-injection", 1, 13, 1, 26)], "likely"),
    "P8": (_PY, 'cur.executemany("a %s" % x, rows)\n', [("python.sql-injection", 1, 17, 1, 27)], "likely"),
    "P9": (_PY, "import pdb\nbreakpoint()\npdb.set_trace()\n", [("python.debug-artifact", 2, 1, 2, 13), ("python.debug-artifact", 3, 1, 3, 16)], "likely"),
    "P10": (_PY, 'cur.execute("select 1")\nlog.breakpoint()\nevaluate(x)\n', [], "likely"),
    "P11": (_PY, "eval(x)\ndef f(:\n", [("python.dangerous-eval", 1, 1, 1, 8)], "possible"),
    "J1": (_JS, "let a = 1;\nconsole.log(a);\n", [("javascript.console-log", 2, 1, 2, 12)], "likely"),
    "J2": (_JS, "db.query(`select ${id}`);\n", [("javascript.sql-injection", 1, 10, 1, 24)], "likely"),
    "J3": (_JS, "try { go(); } catch (e) {}\n", [("javascript.empty-catch-block", 1, 15, 1, 27)], "likely"),
    "J4": (_JS, "if (a == b) { go(); }\n", [("javascript.loose-equality", 1, 5, 1, 11)], "likely"),
    "J5": (_JS, "const z = a == b == c;\n", [("javascript.loose-equality", 1, 11, 1, 22), ("javascript.loose-equality", 1, 11, 1, 17)], "likely"),
    "J6": (_JS, "if (a == null || a === b) { go(); }\n", [], "likely"),
    "J7": (_JS, "eval(s);\nnew Function('return 1');\n", [("javascript.dangerous-eval", 1, 1, 1, 8), ("javascript.dangerous-eval", 2, 1, 2, 25)], "likely"),
    "J8": (_JS, "const s = 'console.log(1)'; // eval(1)\n", [], "likely"),
    "J9": (_JS, "try { go(); } catch (e) { /* skip */ }\n", [], "likely"),
    "J10": (_JS, "window.eval(s); evaluate(s); new Functional();\n", [], "likely"),
    "J11": (_JS, "db.query('select 1');\nlog.raw(`v ${x}`);\n", [], "likely"),
}
