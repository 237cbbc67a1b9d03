"""Changes of nested callables."""

from trajspark.functions.callables import extract_callables
from trajspark.plans import casetype

OLD = """\
def f():
    a = 1
    def g():
        b = 1
        def h():
            return 1
        return h
    return g

class C:
    def m(self):
        return 1
"""


def changed(spark, *edits):
    new = OLD
    for a, b in edits:
        assert a in new
        new = new.replace(a, b, 1)
    old, new = (extract_callables(spark.createDataFrame([("a.py", s)], "file_path string, content string")) for s in (OLD, new))
    return {r.qualified_name: (r.start_line, r.end_line) for r in casetype.modified_callables(old, new).collect()}


def test_inner_changes_are_the_inner_ones(spark):
    assert changed(spark) == {}
    assert changed(spark, ("return 1\n        return h", "return 2\n        return h")) == {"f.<locals>.g.<locals>.h": (5, 6)}
    assert changed(spark, ("b = 1", "b = 2")) == {"f.<locals>.g": (3, 7)}
    assert changed(spark, ("a = 1", "a = 2"), ("self):\n        return 1", "self):\n        return 3")) == {"f": (1, 8), "C.m": (11, 12)}
    # Lines that are added inside move what is behind them, but change no text of the others.
    assert set(changed(spark, ("b = 1", "b = 1\n        c = 2"))) == {"f.<locals>.g"}
    assert changed(spark, ("class C", "class D")) == {}


def test_awkward(spark):
    rows = [("a", "f", 1, 3, "x\ny\nz"), ("a", "f", 7, 7, "w"), ("b", "f", 1, 1, None)]
    old = spark.createDataFrame(rows, "file_path string, qualified_name string, start_line int, end_line int, source string")
    assert [r.own for r in casetype.own_sources(old).orderBy("file_path").collect()][0] == "w"
    assert casetype.modified_callables(old, old).collect() == [] and casetype.modified_callables(old.where("false"), old).collect() == []
