"""Fact tables of Python files: one parse a file, in Arrow batches, written once with a folder for each kind of fact."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfacts.operators.tables import written

from . import lower
from .ports import allowed_calls, flows

SCHEMA = "path string, module string, function string, a long, b long, c long, name string, text string, role string, more string, line int, col int, kind string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in SCHEMA.split(", ")]
#: Kinds of facts and what their columns hold.
KINDS = {
    "file": "name status, text error, a lines, b functions, c functions analysed", "node": "a id, b parent, c ordinal, name kind, role field, text attribute",
    "scope": "a id, b parent, name, text kind", "binding": "a scope, name, text resolution", "import": "name, text symbol", "function": "a parameters, b blocks, name kind, text class",
    "class": "name, text symbol", "base": "a position, name class symbol, text symbol as far as it is known",
    "parameter": "a index, name, role kind, text annotation", "decorator": "a index, text symbol", "block": "a id, b immediate dominator (itself: entry; null: not reached)",
    "edge": "a from, b to, role kind", "instruction": "a block, b place, c result, name operation, text", "operand": "a block, b place, c value, role, name",
    "constant": "a value, name type, text literal", "executable": "a from, b to", "range": "a value, name low, text high", "points": "a value, b object", "heap": "a object, role field, b object",
    "symbol": "a value, text symbol", "call": "a value, name as written, text symbol", "argument": "a call, b position, c value, role, name keyword, text literal or null",
    "allowed": "a call, text the test by which its maker may",
    "prefix": "a call, b position, c 1 if it is the whole value, role, name keyword, text that an argument begins with",
    "flow": "role, a, name of the in-port; text, b, c, more of the out-port; line 1 if a guard tests what flows",
}
_ATTRIBUTES = ("id", "attr", "name", "arg", "module", "value")


def named(files: DataFrame) -> DataFrame:
    """files (path, text, others) with module and is_package: the dotted name from the outermost folder of a run of folders that
    hold an __init__.py down to the file. Where several files would have one name, each takes its whole dotted path."""
    packages = files.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("folder")).distinct()
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    folders = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    above = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/"))).alias("depth", "folder"))
    # depth of the deepest folder above the file that is no package: the name begins behind it
    plain = above.join(packages, "folder", "left_anti").groupBy("path").agg((F.max("depth") + 1).alias("cut"))
    cut = F.least(F.coalesce("cut", F.lit(0)), F.size(parts) - 1)
    short = files.join(plain, "path", "left").withColumn("_short", F.array_join(F.slice(parts, cut + 1, F.size(parts)), "."))
    shared = short.groupBy("_short").agg(F.count("*").alias("_n")).where("_n > 1")
    whole = F.regexp_replace(F.array_join(F.filter(parts, lambda p: p != ""), "."), r"[^A-Za-z0-9_.]", "_")
    return short.join(shared, "_short", "left").withColumns({"module": F.when(F.col("_n") > 1, whole).otherwise(F.regexp_replace("_short", r"[^A-Za-z0-9_.]", "_")), "is_package": F.col("path").rlike(r"(^|/)__init__\.py$"), "ambiguous": F.coalesce(F.col("_n") > 1, F.lit(False))}).drop("cut", "_short", "_n")


def _literal(c: object) -> str | None:
    text = repr(c) if c is not lower.TOP else None
    return text if text is not None and len(text) <= lower.LONGEST_CONSTANT else None


def file_facts(module: str, is_package: bool, text: str | None, sources: tuple[str, ...], nodes: bool, imports_only: bool = False, kinds: tuple[str, ...] | None = None) -> Iterator[dict]:
    """The facts of one file, without path and module. imports_only: its status and imports, without looking at functions.
    kinds: leave out what analyses find that only facts of other kinds need; the caller leaves out the other rows."""
    def wanted(*any_of: str) -> bool:
        return kinds is None or not set(kinds).isdisjoint(any_of)

    try:
        tree = lower.parsed(text or "")
        if lower.too_deep(tree):
            raise RecursionError(f"nested deeper than {lower.DEEPEST}")
        m = lower.Module(module, is_package, tree)
        if imports_only:
            yield {"kind": "file", "name": "analysed" if text is not None else "undecodable", "a": len((text or "").splitlines())}
            for name, symbol, line in m.imports:
                yield {"kind": "import", "name": name, "text": symbol, "line": line}
            return
        m.lower()
        names = lower.scopes(text or "") if nodes else lower.compiles(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        yield {"kind": "file", "name": "syntax-error" if isinstance(error, (SyntaxError, ValueError)) else "unsupported-syntax", "text": str(error)[:300], "line": getattr(error, "lineno", None), "a": len((text or "").splitlines()), "b": 0, "c": 0}
        return
    yield {"kind": "file", "name": "analysed" if text is not None else "undecodable", "a": len((text or "").splitlines()), "b": len(m.functions), "c": len(m.functions)}
    if kinds == ("file",):
        return
    if nodes:
        ids = {id(tree): 0}
        stack: list[tuple[ast.AST, int, str, int]] = [(tree, -1, "", 0)]
        while stack:
            n, parent, role, ordinal = stack.pop()
            me = ids[id(n)]
            shown = next((str(getattr(n, x)) for x in _ATTRIBUTES if isinstance(getattr(n, x, None), (str, int, float, bytes, bool))), None)
            yield {"kind": "node", "a": me, "b": parent, "c": ordinal, "name": type(n).__name__, "role": role, "text": shown, "line": getattr(n, "lineno", None), "col": getattr(n, "col_offset", -1) + 1 or None}
            for fieldname, value in ast.iter_fields(n):
                for k, child in enumerate(value if isinstance(value, list) else [value]):
                    if isinstance(child, ast.AST) and not isinstance(child, (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop)):
                        child = child if id(child) not in ids else child
                        ids[id(child)] = len(ids)
                        stack.append((child, me, fieldname, k))
        for me, parent, kind, name, line, bound in names:
            yield {"kind": "scope", "a": me, "b": parent, "name": name, "text": kind, "line": line}
            for n, how in bound:
                yield {"kind": "binding", "a": me, "name": n, "text": how}
    for name, symbol, line in m.imports:
        yield {"kind": "import", "name": name, "text": symbol, "line": line}
    for name, line, bases in lower.classes(m):
        yield {"kind": "class", "name": name, "text": f"{module}.{name}", "line": line}
        for k, symbol in enumerate(bases):
            yield {"kind": "base", "a": k, "name": f"{module}.{name}", "text": symbol, "line": line}
    for f in m.functions:
        order, idom = lower.ssa(f)
        own = {"function": f.name}
        yield {**own, "kind": "function", "a": len(f.params), "b": len(f.blocks), "name": f.kind, "text": f.owner, "line": f.line}
        for k, (name, kind, symbol) in enumerate(f.params):
            yield {**own, "kind": "parameter", "a": k, "name": name, "role": kind, "text": symbol}
        for k, symbol in enumerate(f.decorators):
            yield {**own, "kind": "decorator", "a": k, "text": symbol}
        known, executable = lower.constants(f, order) if nodes or wanted("argument") else ({}, set())
        symbols = lower.value_symbols(f, order, module) if nodes or wanted("call", "symbol", "flow") else {}
        for block in f.blocks if nodes or wanted("block", "edge", "call", "argument") else ():
            yield {**own, "kind": "block", "a": block.id, "b": idom[block.id]}
            for t, kind in dict.fromkeys(block.succs) if wanted("edge") else ():
                yield {**own, "kind": "edge", "a": block.id, "b": t, "role": kind}
            for at, i in enumerate(block.instrs):
                place = {**own, "line": i.line, "col": i.col}
                if nodes:
                    yield {**place, "kind": "instruction", "a": block.id, "b": at, "c": i.result, "name": i.op, "text": i.text}
                    for role, pos, name, v in i.args:
                        yield {**own, "kind": "operand", "a": block.id, "b": at, "c": v, "role": role, "name": name, "more": str(pos)}
                if i.op == "call":
                    yield {**place, "kind": "call", "a": i.result, "name": i.text, "text": symbols.get(i.args[0][3], "")}
                    for role, pos, name, v in i.args[1:]:
                        yield {**own, "kind": "argument", "a": i.result, "b": pos, "c": v, "role": role, "name": name or "", "text": _literal(known.get(v, lower.TOP)) if known.get(v, lower._NONE) is not lower._NONE else None}
        if nodes:
            for v, c in known.items():
                if c is not lower.TOP:
                    yield {**own, "kind": "constant", "a": v, "name": type(c).__name__, "text": repr(c)}
            for a, b in executable:
                if a >= 0:
                    yield {**own, "kind": "executable", "a": a, "b": b}
            for v, (low, high) in lower.ranges(f, order, known).items():
                yield {**own, "kind": "range", "a": v, "name": repr(low), "text": repr(high)}
            to, heap = lower.points_to(f, order)
            for v, o in to:
                yield {**own, "kind": "points", "a": v, "b": o}
            for o, name, x in heap:
                yield {**own, "kind": "heap", "a": o, "role": name, "b": x}
        made = {i.result: i for b in order for i in f.blocks[b].instrs if i.result is not None}
        for v, i in made.items():
            if i.op == "call" and wanted("prefix"):
                for role, pos, name, arg in i.args[1:]:
                    text, whole = lower.leading_text(made, arg)
                    if text:
                        yield {**own, "kind": "prefix", "a": v, "b": pos, "c": int(whole), "role": role, "name": name or "", "text": text}
        for v, name in allowed_calls(f, order, idom) if wanted("allowed") else ():
            yield {**own, "kind": "allowed", "a": v, "text": name}
        for v, symbol in symbols.items() if wanted("symbol") else ():
            yield {**own, "kind": "symbol", "a": v, "text": symbol}
        for ik, ia, iname, ok, ob, oc, oname, guarded in flows(f, order, idom, symbols, sources) if wanted("flow") else ():
            yield {**own, "kind": "flow", "role": ik, "a": ia, "name": iname, "text": ok, "b": ob, "c": oc, "more": oname, "line": int(guarded)}


def parallel(rows: DataFrame, by: str) -> DataFrame:
    """rows dealt by a column over at least as many tasks as there are cores: the number is given, so adaptive execution does not
    join small partitions, whose bytes say little about the work in them. By a hash of the column, as a table that a join has dealt by
    the column itself would not be dealt again."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(by))


def facts(files: DataFrame, sources: tuple[str, ...] = (), nodes: bool = True, imports_only: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All facts (SCHEMA; see KINDS) of files (path, text), a written table in folders by kind.

    sources: symbols, dotted prefixes, whose values begin a flow. nodes: also syntax, scopes, instructions and value analyses,
    which whole-project checks don't read. A file that can't be parsed gives one fact of kind 'file' with a status; a null text
    is an empty file with the status 'undecodable'. Files are independent of one another: they are dealt by path, and read by as
    many tasks as there are cores or shuffle partitions. imports_only: facts of the kinds 'file' (without functions) and 'import'.
    kinds: the only kinds of facts that are wanted, if not all. files may come with module and is_package.
    """
    rows = (files if "module" in files.columns else named(files.select("path", "text"))).select("path", "module", "is_package", "text")
    rows = parallel(rows, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {n: [] for n in _NAMES}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(_NAMES, _TYPES)], names=_NAMES)
            for c in columns.values():
                c.clear()
            return made

        for batch in batches:
            for path, module, is_package, text in zip(*(c.to_pylist() for c in batch.columns)):
                for fact in file_facts(module, is_package, text, sources, nodes, imports_only, kinds):
                    if kinds is not None and fact["kind"] not in kinds:
                        continue
                    fact["path"], fact["module"] = path, module
                    for n in _NAMES:
                        columns[n].append(fact.get(n))
                    if len(columns["kind"]) >= 20_000:
                        yield flush()
        if columns["kind"]:
            yield flush()

    return written(rows.mapInArrow(run, SCHEMA), "facts", by="kind")


def of(facts: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind."""
    return facts.where(F.col("kind") == kind).drop("kind")
