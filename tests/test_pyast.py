import ast
import math

import pytest

from metrospect.functions import pyast
from metrospect.functions.pyast import enclosed, parses_cleanly, python_metrics, with_python_metrics

SIMPLE = "def area(width, height):\n    whole = width * height\n    return whole / 2\n"
BRANCHY = (
    "def grade(points):\n    while points > 90:\n        points -= 1\n"
    "    if points and points % 2:\n        return 'odd'\n    return 'even'\n"
)
SCRIPT = "total = 0\nlimit = 5  # upper end\nprint(total)\n# done\n"


@pytest.mark.parametrize(
    "source,ok",
    [("x = 1", True), ("def foo(", False), ("s = 'héllo wörld'", True), ("'\\d'", False),
     ("a\0b", False), ("", True)],
)
def test_validity(source, ok):
    assert parses_cleanly(source) is ok


def test_statements_without_a_function_are_enclosed():
    tree = enclosed(ast.parse(SCRIPT))
    assert [node.name for node in tree.body] == ["_module"] and len(tree.body[0].body) == 3
    with pytest.raises(IndentationError):
        enclosed(ast.parse("# nothing\n"))


def test_simple_and_branchy_function():
    simple = python_metrics(SIMPLE)
    assert simple["cc"] == 1 and simple["comment_ratio"] == 0 and simple["sloc"] == 3
    assert 0 <= simple["mi"] <= 100
    assert simple["h_volume"] == pytest.approx(6 * math.log2(2 + 4))
    assert python_metrics(BRANCHY)["cc"] == 4
    assert python_metrics(SCRIPT)["comment_ratio"] == pytest.approx(1 / 3)


def test_decisions_strings_and_docstrings():
    source = (
        '"""Doc\nstring."""\n\nclass A:\n    """One line."""\n    def f(self, xs):\n'
        "        return [x for x in xs if x and self]  # '#' in a comment\n"
        "    def g(self):\n        s = '# no comment'\n"
        "        try:\n            pass\n        except ValueError:\n            pass\n"
    )
    # Without a top-level function the class sits in the wrapper, which has no branch of its own.
    assert python_metrics(source)["cc"] == 1
    found = python_metrics(source + "def h():\n    return 1\n")
    assert found["cc"] == 4
    assert found["sloc"] == 11
    assert found["comment_ratio"] == pytest.approx(1 / (15 + 1))


def test_spark_stage_captures_failures(spark):
    df = spark.createDataFrame(
        [(1, SIMPLE), (2, "def foo("), (3, ""), (4, "# only"), (5, None), (6, SIMPLE)],
        "id int, source string",
    ).repartition(2)
    rows = {r["id"]: r for r in with_python_metrics(df).collect()}
    assert rows[1]["cc"] == rows[6]["cc"] == 1 and rows[1]["metrics_error"] is None
    assert rows[2]["metrics_error"] == "SyntaxError" and rows[2]["valid"] is False
    assert rows[3]["metrics_error"] == "IndentationError" and rows[3]["valid"] is True
    assert rows[4]["metrics_error"] == "IndentationError" and rows[4]["mi"] is None
    assert rows[5]["valid"] is False and rows[5]["sloc"] is None


def test_one_walk_meets_every_node_once(monkeypatch):
    source = "class A:\n    def f(self, a=1 if x else y):\n        if a and b:\n            return [i for i in a if i > -1]\n\nx = 5\n" * 20
    tree = ast.parse(source)
    met, visit = [], pyast.Survey.visit
    monkeypatch.setattr(pyast.Survey, "visit", lambda self, node, *around: (met.append(node), visit(self, node, *around)))
    found = pyast.Survey(tree)
    assert len(met) == len(set(met)) == sum(type(node) not in pyast.IDLE for node in ast.walk(tree))
    assert (found.statements, found.functions, found.total_branches()) == (20 * 5, 20, 20 * 6)
