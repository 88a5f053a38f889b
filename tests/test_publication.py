"""Nested results as long paths, and the rows of tables that are taken from them."""

import json

from lumaspec.sources import publication
from lumaspec.sources.publication import Entry


def _plain(node, path=()):
    if isinstance(node, (dict, list)):
        for k, v in node.items() if isinstance(node, dict) else enumerate(node):
            yield from _plain(v, (*path, str(k).replace("~", "~0").replace(".", "~1")))
    else:
        yield ".".join(path), node


def test_every_leaf_has_its_path(spark):
    docs = [("a", {"x": {"y.z": [1, {"q~": "t"}], "n": None, "b": True, "e": {}}, "f": 1.5, "deep": {"er": [[[2]], "3"]}}), ("b", [{"x": False}, [], "word"]), ("c", 7), ("c", {"f": 2})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs] + [("d", "not {json"), ("e", None), ("f", "{}")], "k string, report string")
    got = {(r["k"], r["path"]): (r["value"], r["number"]) for r in publication.leaves(df, "k", "report").collect()}
    want = {(k, p): v for k, doc in docs for p, v in _plain(doc)}
    assert got.keys() == want.keys()
    for at, (value, number) in got.items():
        v = want[at]
        assert (value is None) == (v is None)
        if isinstance(v, (bool, int, float)):
            assert number == float(v)
        elif isinstance(v, str):
            assert value == v
    assert publication.leaves(df.where("false"), "k", "report").count() == 0


def test_intervals_are_turned_and_judged(spark):
    report = {"c": {"up": {"mean": 0.3, "ci_low": 0.1, "ci_high": 0.5}, "down": {"mean": -0.2, "ci_low": -0.3, "ci_high": -0.1}, "both": {"mean": 0.0, "ci_low": -1, "ci_high": 1}, "half": {"mean": 2}}, "passed": False}
    found = publication.leaves(spark.createDataFrame([("r", json.dumps(report)), ("s", None)], "k string, j string"), "k", "j")
    wanted = [Entry("u", "r", "c.up"), Entry("d", "r", "c.down"), Entry("t", "r", "c.down", turned=True), Entry("b", "r", "c.both"), Entry("h", "r", "c.half"), Entry("p", "r", "passed", single=True), Entry("gone", "s", "c.up")]
    rows = [tuple(r) for r in publication.entries(found, "k", wanted).orderBy("place").collect()]
    assert rows == [
        (0, "u", 0.3, 0.1, 0.5, False, "advantage", "r:c.up"), (1, "d", -0.2, -0.3, -0.1, False, "disadvantage", "r:c.down"), (2, "t", 0.2, 0.1, 0.3, False, "advantage", "r:c.down"),
        (3, "b", 0.0, -1.0, 1.0, True, "inconclusive", "r:c.both"), (4, "h", 2.0, None, None, None, "value", "r:c.half"), (5, "p", 0.0, None, None, None, "value", "r:passed"), (6, "gone", None, None, None, None, "missing", "s:c.up"),
    ]
