"""Ignore rules as a relation against the plain judgement of one path at a time."""

import random

import pytest

from siltwork.sources import files

RULES = {
    "a": {"": "*.log\n!keep.log\nbuild/\n/top.ts\ndoc/**/x.ts\n# c\n\\#odd\nsp\\ ace\n", "src": "!*.log\nb?ild.ts\n[ab]*.js\n[!a-c]z\n", "src/deep": "*\n!y.*\n"},
    "b": {"": "/src/**\n!src/deep\n", "doc": "a.b\n[&]\n[\\[x]1\n"},
    "c": {},
}
NAMES = ["x.ts", "y.ts", "keep.log", "t.log", "T.LOG", "top.ts", "build", "bOild.ts", "aa.js", "ca.js", "dz", "az", "#odd", "sp ace", "a.b", "aXb", "&", "[1", "x1"]
FOLDERS = ["", "src/", "src/deep/", "doc/", "doc/m/n/", "build/", "src/build/", "keep.log/"]


@pytest.mark.parametrize("keyed", [True, False])
def test_relation_equals_plain_judgement(spark, keyed):
    rng = random.Random(2)
    snapshots = list(RULES) if keyed else ["a"]
    rows = [(s, f + n, i) for i, (s, f, n) in enumerate((rng.choice(snapshots), f, n) for f in FOLDERS for n in NAMES for _ in range(2))]
    rows += [("a", "x.ts", 1000), ("a", "x.ts", 1001), ("a", None, 1002)]
    rules = [(s, d, t) for s in snapshots for d, t in RULES[s].items()] + [("a", "none", None)]
    f, r = spark.createDataFrame(rows, "snapshot string, path string, id int"), spark.createDataFrame(rules, "snapshot string, directory string, rules string")
    got = files.with_ignored(f, r, ["snapshot"]) if keyed else files.with_ignored(f, r.drop("snapshot"))
    got = {x["id"]: x["ignored"] for x in got.collect()}
    assert got == {i: p is not None and files.ignored(p, RULES[s]) for s, p, i in rows}
    assert 0.2 < sum(got.values()) / len(got) < 0.8


def test_many_rules_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(files, "BROADCAST_RULES", 0)
    f = spark.createDataFrame([("a/b.ts",), ("a/c.ts",)], "path string")
    r = spark.createDataFrame([("", "b.*"), ("a", "!b.ts\nc.ts")], "directory string, rules string")
    assert {x["path"]: x["ignored"] for x in files.with_ignored(f, r).collect()} == {"a/b.ts": False, "a/c.ts": True}
    assert files.with_ignored(f, r.limit(0)).where("ignored").count() == 0 and files.with_ignored(f.limit(0), r).count() == 0
