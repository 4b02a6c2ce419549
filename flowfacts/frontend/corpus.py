"""Python projects written from rows of the driver's tables, so that what a check must find is known by SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line 15 of a web module, by c_custkey % 12; {q} is the key.
LINES = [
    "    sqlite3.connect('d').execute('select ' + q)",
    "    sqlite3.connect('d').execute('select ?', (q,))",
    "    os.system('ls ' + name)",
    "    os.system('ls ' + str(clean(q)))",
    "    hashlib.md5(q.encode())",
    "    requests.get('http://host/' + q, timeout=3)",
    "    requests.get('http://host/', verify=False)",
    "    eval(q)",
    "    Runner(q).run_{k3}(q)",
    "    open('/data/' + q)",
    "    redirect(q)",
    "    def (",
]
WEB = """import os
import sqlite3
import hashlib
import requests
from flask import Flask, request, redirect
from .shared import Runner
app = Flask(__name__)

def clean(value):
    return int(value)

@app.route('/x')
def view_{k}(name):
    q = request.args.get('q')
{line}
    return q
"""
SHARED = """import os

class Runner:
    def __init__(self, first):
        self.first = first

    def run_0(self, cmd):
        os.system(cmd)

    def run_1(self, cmd):
        os.popen(self.first)

    def run_2(self, cmd):
        return self.run_0(str(cmd) + 'x')
"""
#: A module of arithmetic by s_suppkey: x, y and t are numbers of the row.
NUMBERS = """import math as m
from os import path

def work(n):
    a = {x}
    b = a * {y}
    if a > {t}:
        c = b + 1
    else:
        c = 0
    total = 0
    for i in range(n):
        total = total + i
    items = []
    items.append(a)
    return c

def {name}(k, *rest):
    try:
        return m.sqrt(k)
    except ValueError as error:
        raise
"""


#: The guard of a module by s_suppkey: what stands before the call, and whether it proves, tests or ignores what flows.
GUARDS = [
    ("if q:", "hotspot"), ("if q.isdigit():", None), ("if q in ('a', 'b'):", None), ("if q == 'x' and os.sep:", None), ("if len(os.sep):", "vulnerability"), ("if not q.isalnum():", "hotspot"),
    ("if not (q != 'x' or os.sep):", None), ("if q not in ['a', 'b']:", "hotspot"), ("for i in range(3):", "vulnerability"), ("if re.fullmatch('[a-z]+', q):", None), ("if q == other:", "hotspot")]
GUARDED = """import os
import re

def handle(other):
    q = input()
    {guard}
        os.system(q)
    return other
"""


#: Classes of a web project: one root, two in each module of a nation, one in each module of a supplier, which does what LEAVES say.
ROOT = """import os
import tornado.web

class Root(tornado.web.RequestHandler):
    def run(self, cmd):
        os.system(cmd)
"""
MIDDLE = """from .root import Root

class Extra:
    def title(self):
        return 'title'

class Mid{k}(Root):
    def store(self):
        self.held = self.get_argument('h')

class Mix{k}(Mid{k}, Extra):
    pass
"""
LEAVES = ["self.run(self.get_argument('q'))", "os.system(self.get_argument('q'))", "os.system(self.request.body)", "os.system(name)", "os.system(self.title())", "os.system(self.held)"]
LEAF = """import os
from .mid{m} import Mix{m}

class Leaf{k}(Mix{m}):
    def get(self, name):
        {line}

    def other(self, name):
        os.system(name)

class Plain{k}:
    def get(self, name):
        os.system(name)
"""


def class_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a root, a module a nation, a module a supplier whose class is three levels below the root."""
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    middle = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("views/mid"), n, F.lit(".py")).alias("path"), _filled(MIDDLE, k=n).alias("text"))
    line = F.element_at(F.array(*map(F.lit, LEAVES)), (k % len(LEAVES)).cast("int") + 1)
    leaf = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("views/leaf"), k, F.lit(".py")).alias("path"), _filled(LEAF, line=line, m=k % 25, k=k).alias("text"))
    return leaf.unionByName(middle).unionByName(spark.createDataFrame([("views/__init__.py", ""), ("views/root.py", ROOT)], "path string, text string"))


#: A module of loops by s_suppkey.
LOOPS = """def work(n):
    up = {x}
    down = {y}
    both = {x}
    for i in range(n):
        up = up + {s}
        down = down - 1
        for j in range(n):
            both = both * 2 - {y}
    part = len(n) % {m}
    half = up // 2
    return part
"""


def loop_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a module a supplier, whose loops count up or down by the row's numbers."""
    k = F.col("s_suppkey")
    text = _filled(LOOPS, x=k % 7, y=k % 5 + 1, s=k % 3, m=k % 4 + 1)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("loops/mod"), k, F.lit(".py")).alias("path"), text.alias("text"))


#: A web module by s_suppkey: three handlers that call a helper, each open, decorated, or behind a test, by the row's number.
HANDLERS = """import os
from flask import Flask, request
from flask_login import login_required, current_user
app = Flask(__name__)

def deep(cmd):
    os.system(cmd)

def helper(cmd):
    deep(cmd)

@app.route('/a')
{first}
def one():
    helper(request.args['a'])

@app.route('/b')
def two():
    if {second}:
        return 'no'
    helper(request.args['b'])

@app.route('/c')
def three():
    if current_user.is_authenticated and request.args:
        os.system(request.args['c'])
    {third}
"""


def handler_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one module a supplier."""
    k = F.col("s_suppkey")
    text = _filled(HANDLERS, first=F.when(k % 2 == 0, "@login_required").otherwise("# open"), second=F.when(k % 3 == 0, "not current_user.is_authenticated").otherwise("request.method == 'HEAD'"),
                   third=F.when(k % 5 == 0, "os.system(request.args['d'])").otherwise("return 'done'"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("web/mod"), k, F.lit(".py")).alias("path"), text.alias("text"))


#: Calls of a library by s_suppkey % their number, each with what its advisory's conditions become: texts that are met and pending,
#: the contradicted one, and what was passed instead.
CALLS = [
    ("parse(text, mode=vulnlib.UNSAFE)", ["mode"], ["tag"], None, None), ("parse(text, vulnlib.UNSAFE)", ["mode"], ["tag"], None, None), ("parse(text)", ["mode"], ["tag"], None, None),
    ("parse(text, mode=vulnlib.SAFE)", [], [], "mode", "vulnlib.SAFE"), ("parse(text, mode=None)", [], [], "mode", "None"), ("parse(text, mode=choice)", [], ["mode", "tag"], None, None),
    ("parse(text, **options)", [], ["mode", "tag"], None, None), ("parse(*rest)", [], ["mode", "tag"], None, None), ("serve(path, follow=True)", ["follow"], [], None, None), ("serve(path, follow=False)", [], [], "follow", "False"),
    ("serve(path)", [], [], "follow", None), ("fetch('http://host/' + path, allow_redirects=False)", [], [], "host", "'http://host'"), ("fetch('http://host/' + path)", [], ["the host is fixed by 'http://host', but a redirect may lead elsewhere"], None, None),
    ("fetch(path)", [], ["host"], None, None), ("send(a=1, b=2)", [], [], "keys", "a, b"), ("send(**options)", [], ["keys"], None, None), ("sign(path)", [], [], "key", None), ("sign(path, key=choice)", ["key"], [], None, None),
]
CALLER = "import vulnlib\n\ndef run(text, path, choice, options, rest):\n    return vulnlib.{call}\n"
#: symbol: conditions (kind, text, argument, position, values, default, present, method).
CONDITIONS = {
    "vulnlib.parse": [("argument", "mode", "mode", 1, ["vulnlib.UNSAFE"], True, False, None), ("semantic", "tag", None, None, None, None, None, None)], "vulnlib.serve": [("argument", "follow", "follow", None, ["True"], False, False, None)],
    "vulnlib.fetch": [("host", "host", "url", 0, None, None, None, None)], "vulnlib.send": [("keyword_name", "keys", None, None, None, None, None, None)], "sign": [("argument", "key", "key", None, None, None, True, None)],
}


def caller_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one module a supplier with one call."""
    k = F.col("s_suppkey")
    call = F.element_at(F.array(*[F.lit(c[0]) for c in CALLS]), (k % len(CALLS)).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("calls/mod"), k, F.lit(".py")).alias("path"), _filled(CALLER, call=call).alias("text"))


#: Templates by s_suppkey: parts that include the part of half their number (the first the last, so there is a cycle), one in
#: eleven with a value marked safe, and pages with a part in a block of one of three bases.
PART = "<i title=\"{{ a }}\">{{ b{mark} }}</i>{% if c %}{% include 'part{next}.html' %}{% endif %}"
PAGE = "{% extends 'base{base}.html' %}{% block main %}{% include 'part{k}.html' %}{% endblock %}{head}"
BASES = ["<p>{% block main %}{% endblock %}</p>", "<script>{% block main %}{% endblock %}</script>", "{% block head %}{{ h|safe }}{% endblock %}<p>{% block main %}{% endblock %}</p>"]


def template_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a part and a page a supplier, and the bases."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("k").alias("last"))))  # one row
    k = F.col("k")
    part = _filled(PART, mark=F.when(k % 11 == 0, "|safe").otherwise(""), next=F.when(k == 1, F.col("last")).otherwise(F.expr("k DIV 2")))
    page = _filled(PAGE, base=k % 3, k=k, head=F.when(k % 2 == 0, "{% block head %}{% endblock %}").otherwise(""))
    made = [rows.select(F.concat(F.lit(f"shop/templates/{kind}"), k, F.lit(".html")).alias("path"), text.alias("text")) for kind, text in (("part", part), ("page", page))]
    return made[0].unionByName(made[1]).unionByName(spark.createDataFrame([(f"shop/templates/base{n}.html", text) for n, text in enumerate(BASES)], "path string, text string"))


#: A module by s_suppkey: helpers that give back one parameter or none, callers with untrusted and with written values, functions
#: that call one another, and a chain over modules that ends at every tenth and closes to a cycle.
HELPERS = """import os
import shlex
import sqlite3
from .mod{next} import below as deeper

def pick(a, b):
    return {picked}

def quoted(v):
    return shlex.quote(v)

def even(n, v):
    return odd(n - 1, v)

def odd(n, v):
    if n:
        return even(n - 1, v)
    return v

def below(value, depth):
    return {below}

def first(x):
    os.system(pick(input(), 'c'))

def second(x):
    os.system(pick('c', 'd'))

def third(x):
    os.system(even('c', input()))

def fourth(x):
    os.system(odd(input(), 'c'))

def fifth(x):
    os.system(quoted(input()))
    sqlite3.connect('d').execute(quoted(input()))

def sixth(x):
    os.system(below(input(), 'c'))

def seventh(x):
    os.system(below('c', input()))

def read():
    return input()

def eighth(x):
    os.system(pick(read(), read()))
"""


def helper_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one module a supplier, each importing the next; the last imports the first."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    last = rows.agg(F.max("k").alias("last"), F.min("k").alias("least"))
    k = F.col("k")
    text = _filled(HELPERS, next=F.when(k == F.col("last"), F.col("least")).otherwise(k + 1), picked=F.when(k % 2 == 0, "a").otherwise("b"), below=F.when(k % 10 == 0, "value").otherwise("deeper(value, depth)"))
    made = rows.crossJoin(F.broadcast(last)).select(F.concat(F.lit("helpers/mod"), k, F.lit(".py")).alias("path"), text.alias("text"))  # one row of ends
    return made.unionByName(spark.createDataFrame([("helpers/__init__.py", "")], "path string, text string"))


def guard_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one module a supplier, with a guard before its call."""
    k = F.col("s_suppkey")
    guard = F.element_at(F.array(*[F.lit(g) for g, _ in GUARDS]), (k % len(GUARDS)).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("g/mod"), k, F.lit(".py")).alias("path"), _filled(GUARDED, guard=guard).alias("text"))


def _filled(text: str, **columns: Column) -> Column:
    out = F.lit(text)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def web_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one module a customer, a shared one, and the package they are in."""
    k = F.col("c_custkey")
    line = F.element_at(F.array(*map(F.lit, LINES)), (k % len(LINES)).cast("int") + 1)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("proj/mod"), k, F.lit(".py")).alias("path"), _filled(WEB, line=line, k=k, k3=k % 3).alias("text"))
    fixed = spark.createDataFrame([("proj/__init__.py", ""), ("proj/shared.py", SHARED)], "path string, text string")
    return rows.unionByName(fixed)


def number_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one module a supplier, outside any package; every fifth name is used twice."""
    k = F.col("s_suppkey")
    place = F.when(k % 5 == 0, F.concat(F.lit("a"), k % 2, F.lit("/num"), F.expr("s_suppkey DIV 10"))).otherwise(F.concat(F.lit("b/num_"), k))
    text = _filled(NUMBERS, x=k % 7, y=k % 5 + 1, t=F.lit(3), name=F.when(k % 3 == 0, "work").otherwise("other"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(place, F.lit(".py")).alias("path"), text.alias("text"))
