"""Innermost intervals, carried sweeps and must-analysis against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from flowfacts.frontend import models, tables, taint
from flowfacts.operators.coverage import covered, uncovered
from flowfacts.operators.sweep import innermost, swept


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """With one range, and with as many as there are partitions, so that keys cross ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def nested(rng, low, high, out, depth=0):
    """Random nested intervals within low..high."""
    at = low
    while at < high and rng.random() < 0.9:
        begin = rng.randint(at, high)
        end = rng.randint(begin, high)
        out.append((begin, end))
        if depth < 4:
            nested(rng, begin, end, out, depth + 1)
        at = end + 1


def test_innermost_intervals(spark, ranges):
    rng = random.Random(7)
    rows, points = [], []
    for key in ["hot", *"abcde", None]:
        own = []
        for part in range(60 if key == "hot" else 3):
            nested(rng, part * 100, part * 100 + 99, own)
        rows += [(key, n, b, e) for n, (b, e) in enumerate(dict.fromkeys(own))]
        points += [(key, rng.randint(-5, 6010 if key == "hot" else 310), f"p{n}") for n in range(2000 if key == "hot" else 60)]
    points += [points[0], ("only points", 3, "x")]
    rows += [("hot", 100_000, 5, 4), ("a", 100_001, 7, 2)]  # these hold nothing
    want = []
    for key, at, name in points:
        around = [(e - b, n) for k, n, b, e in rows if k == key and b <= at <= e]
        want.append((str(key), at, name, min(around)[1] if around else None, len(around)))
    intervals = spark.createDataFrame(rows, "file string, id long, begin long, end long")
    got = innermost(spark.createDataFrame(points, "file string, at long, name string"), intervals, ["file"])
    assert sorted(map(str, ((str(r.file), r.at, r.name, r.inside, r.depth) for r in got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert innermost(got.where("false").select("file", "at"), intervals, ["file"]).count() == 0


def test_sums_and_last_values_are_carried_over_ranges(spark, ranges):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), n, rng.choice([None, 1, 2, -3]), rng.choice([None, None, "x", "y"])) for n in range(3000)]
    got = {r.n: (r.total, r.seen) for r in swept(spark.createDataFrame(rows, "k string, n int, v int, s string"), ["k"], ["n"], {"total": F.col("v")}, {"seen": F.col("s")}).collect()}
    total, seen = {}, {}
    for k, n, v, s in rows:
        total[k], seen[k] = total.get(k, 0) + (v or 0), s or seen.get(k)
        assert got[n] == (total[k], seen[k])


def test_covered_functions(spark):
    rng = random.Random(9)
    for _ in range(3):
        names = [f"f{k}" for k in range(60)]
        functions = [(n, rng.random() < 0.2, rng.random() < 0.1) for n in names] + [("f1", None, None)]
        calls = [(rng.choice(names), rng.choice(names), rng.random() < 0.4) for _ in range(110)]
        guarded = {n for n, g, _ in functions if g}
        inside = {b for a, b, _ in calls if a != b}
        open_ = {n for n, _, e in functions if n not in guarded and (e or n not in inside)}
        while True:
            more = {b for a, b, g in calls if a in open_ and not g and b not in guarded} - open_
            if not more:
                break
            open_ |= more
        f = spark.createDataFrame(functions, "function string, guarded boolean, entry boolean")
        c = spark.createDataFrame(calls, "caller string, callee string, guarded boolean")
        assert {r.function for r in uncovered(f, c).collect()} == open_
        assert {r.function for r in covered(f, c).collect()} == set(names) - open_


def test_authorized_helpers_are_hotspots(spark):
    head = "import os\nfrom flask import Flask, request\nfrom flask_login import login_required, current_user\napp = Flask(__name__)\n"
    files = {
        "a.py": head + "def run(c):\n    os.system(c)\n@app.route('/x')\n@login_required\ndef one():\n    run(request.args['x'])\n",
        "b.py": head + "def run(c):\n    os.system(c)\n@app.route('/x')\n@login_required\ndef one():\n    run(request.args['x'])\n@app.route('/y')\ndef two():\n    run(request.args['y'])\n",
        "c.py": head + "@app.route('/x')\ndef one():\n    if not (current_user.is_authenticated and current_user.has_role('a')):\n        return ''\n    os.system(request.args['x'])\n",
        "d.py": head + "@app.route('/x')\ndef one():\n    if current_user.is_authenticated or request.args:\n        os.system(request.args['x'])\n",
    }
    found = taint.flows(tables.facts(spark.createDataFrame(list(files.items()), "path string, text string"), models.prefixes(), nodes=False))
    assert {r.path: r.verdict for r in found.collect()} == {"a.py": "hotspot", "b.py": "vulnerability", "c.py": "hotspot", "d.py": "vulnerability"}
