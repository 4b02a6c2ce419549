"""Whole-project taint on fact tables: a semi-naive fixpoint over ports, the parameters, results and fields that functions meet at.

Inside a function the fact table already tells which in-port reaches which out-port (kind 'flow'). Calls are joined with the
functions they name, summaries make a call one step from argument to result (``summaries``), and kinds of taint spread along
steps until nothing is new. Rounds grow with the depth of calls, not with the length of functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfacts.operators import coverage
from flowfacts.operators.models import suffixes
from flowfacts.operators.tables import discard, if_small, written

from . import classes, models
from .tables import of

#: Kinds of facts that ``flows`` reads, and that ``reported_calls`` reads more.
FLOW_KINDS = ("function", "call", "parameter", "decorator", "class", "base", "prefix", "allowed", "flow")
CALL_KINDS = ("call", "argument")
KEY = ("module", "function", "role", "a", "name")


def key_of(module: Column | str, function: Column | str, role: str | Column, a: Column | str, name: Column | str) -> Column:
    text = [F.col(x) if isinstance(x, str) else x for x in (module, function)]
    role = F.lit(role) if isinstance(role, str) else role
    a, name = (F.col(x) if isinstance(x, str) else x for x in (a, name))
    return F.concat_ws("|", *text, role, a.cast("string"), name)


def resolved(facts: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Calls (module, function, a: the call's value, symbol) with the project's function they name, if any: (to_module,
    to_function, shift: how far positions move, as a method's first parameter is its object). A class stands for its __init__.
    lines: the classes' ancestors, by which a member that a class does not define means that of its first ancestor that does; the
    symbol is then the ancestor's, and ``named`` the one before."""
    functions = of(facts, "function").where("name <> 'module' AND name <> 'class'").select(F.col("module").alias("to_module"), F.col("function").alias("to_function"), F.col("name").alias("how"))
    named = functions.withColumn("symbol", F.concat_ws(".", "to_module", "to_function"))
    made = functions.where(F.col("to_function").endswith(".__init__")).withColumn("symbol", F.concat_ws(".", "to_module", F.regexp_replace("to_function", r"\.__init__$", "")))
    targets = named.unionByName(made).withColumn("shift", F.when(F.col("how") == "method", 1).otherwise(0)).drop("how")
    targets = targets.groupBy("symbol").agg(F.min_by(F.struct("to_module", "to_function", "shift"), F.struct("to_module", "to_function")).alias("t")).select("symbol", "t.*")
    calls = of(facts, "call").select("path", "module", "function", "a", F.col("text").alias("symbol"), F.col("name").alias("written"), "line", "col").withColumn("named", F.col("symbol"))
    if lines is not None:
        calls = calls.join(classes.inherited(facts, lines), "symbol", "left").withColumn("symbol", F.coalesce("means", "symbol")).drop("means")
    return calls.join(targets, "symbol", "left")


def seeds(facts: DataFrame, calls: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(key, source, bits): in-ports that hold untrusted values from the start, and what they come from: sources by symbol,
    parameters of entry points by decorator or base class, attributes and inherited calls by base class."""
    spark = facts.sparkSession
    read = of(facts, "flow").where("role = 'source'").select(key_of("module", "function", F.col("role"), "a", "name").alias("key"), F.col("name").alias("source"))
    entries = models.entry_table(spark)
    handlers = of(facts, "decorator").join(F.broadcast(entries), F.col("text") == F.col("symbol")).select("module", "function", "text").distinct()
    given = of(facts, "parameter").where("role <> 'captured'").drop("text", "path").join(handlers, ["module", "function"]).select(key_of("module", "function", "param", "a", F.lit("")).alias("key"), F.concat_ws(" ", "text", "name").alias("source"))
    found = read.unionByName(given)
    if lines is not None:
        entries = classes.entry_points(facts, lines)
        parameters = of(facts, "parameter").where("role <> 'captured' AND a > 0").join(entries, ["module", "function"])
        found = found.unionByName(parameters.select(key_of("module", "function", "param", "a", F.lit("")).alias("key"), F.concat_ws(" ", "base", "name").alias("source")))
        found = found.unionByName(classes.attributes(facts, lines).select(key_of("module", "function", "field", "a", "name").alias("key"), "source"))
        found = found.unionByName(classes.sources(calls).select(key_of("module", "function", "result", "a", F.lit("")).alias("key"), "source"))
    return found.distinct().withColumn("bits", F.lit(models.ALL).cast("long"))


def spread(start: DataFrame, along: DataFrame, fold: int = 8) -> DataFrame:
    """(key, source, bits): the least fixpoint of start under the steps (key, into, mask). Each round joins only what is new;
    the parts of the state are folded into one every few rounds, and all tables but the result are deleted."""
    delta = written(start, "taint")
    parts, used = [delta], []
    rounds = 0
    while delta.limit(1).count():
        rounds += 1
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        moved = delta.join(along, "key").select(F.col("into").alias("key"), "source", F.col("bits").bitwiseAND(F.col("mask")).alias("bits")).where("bits <> 0").groupBy("key", "source").agg(F.bit_or("bits").alias("bits"))
        old = known.groupBy("key", "source").agg(F.bit_or("bits").alias("_old"))
        fresh = moved.join(old, ["key", "source"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))).where("bits <> 0").select("key", "source", "bits")
        delta = written(fresh, "taint")
        parts.append(delta)
        if len(parts) > fold:
            folded = parts[0]
            for p in parts[1:]:
                folded = folded.unionByName(p)
            whole = written(folded.groupBy("key", "source").agg(F.bit_or("bits").alias("bits")), "taint")
            used += parts[:-1]
            parts = [whole, delta]
            discard(*[u for u in used if u is not delta])
            used = []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key", "source").agg(F.bit_or("bits").alias("bits"))


def covered_functions(facts: DataFrame, calls: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(module, function) that run only for those who may: by a decorator, or as every call on every way to them is made by such a
    function or after a test. Entry points by decorator or base class are begun from outside."""
    spark = facts.sparkSession
    name = F.concat_ws("|", "module", "function")
    decorated = of(facts, "decorator").select("module", "function", F.col("text").alias("symbol")).distinct()
    guarded = decorated.join(F.broadcast(models.authorizing_table(spark)), "symbol").select(name.alias("function"), F.lit(True).alias("guarded"), F.lit(False).alias("entry"))
    begun = decorated.join(F.broadcast(models.entry_table(spark)), "symbol").select("module", "function")
    if lines is not None:
        begun = begun.unionByName(classes.entry_points(facts, lines).select("module", "function"))
    own = of(facts, "function").select(name.alias("function"), F.lit(False).alias("guarded"), (F.col("name") == "module").alias("entry"))
    functions = own.unionByName(guarded).unionByName(begun.select(name.alias("function"), F.lit(False).alias("guarded"), F.lit(True).alias("entry")))
    tested = of(facts, "allowed").select("module", "function", "a", F.lit(True).alias("tested")).distinct()
    known = calls.where("to_function IS NOT NULL").join(tested, ["module", "function", "a"], "left").select(
        name.alias("caller"), F.concat_ws("|", "to_module", "to_function").alias("callee"), F.coalesce("tested", F.lit(False)).alias("guarded"))
    found = coverage.covered(functions, known)
    parts = F.split("function", r"\|")
    return found.select(parts[0].alias("module"), parts[1].alias("function"))


def url_proof(prefix: Column) -> Column:
    """What the constant beginning of a URL fixes: 'path' (host and path), 'origin' (the host), 'site' (a path on the same site), else
    null."""
    return F.when(prefix.rlike(r"^https?://[^/?#\\]+/[^?#]*[?#]"), "path").when(prefix.rlike(r"^https?://[^/?#\\]+[/?#]"), "origin").when(prefix.rlike(r"^/[^/\\]"), "site")


def flows(facts: DataFrame) -> DataFrame:
    """One row per harmful flow: path, module, function, line, col, symbol, rule, severity, sources, and the verdict: 'hotspot' if
    a guard tests every source on its way, a request's host is written out, or it runs only for those who may, 'vulnerability' if not. What guards show to be
    harmless is no flow, nor is a redirect to a written host or a path on the same site."""
    spark = facts.sparkSession
    from .summaries import matched_steps, places

    lines = None if of(facts, "base").isEmpty() else classes.ancestors(facts)
    calls = written(resolved(facts, lines), "calls")
    along = written(matched_steps(facts, calls, lines), "steps")
    state = places(spread(seeds(facts, calls, lines), along))
    sinks = models.sink_table(spark)
    ends = calls.where("to_function IS NULL AND symbol <> ''").withColumn("suffix", F.explode(suffixes(F.col("symbol")))).join(F.broadcast(sinks), "suffix")
    plain = calls.where("to_function IS NULL AND symbol = ''").withColumn("suffix", F.explode(suffixes(F.col("written")))).join(F.broadcast(sinks), "suffix")
    ends = ends.unionByName(plain).select("path", "module", "function", F.col("a").alias("call"), F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), F.col("written")).alias("symbol"), "line", "col", "rule", "severity", F.col("bits").alias("harm"), "positions").distinct()
    given = of(facts, "flow").where("text = 'arg' AND c <> -1").select("module", "function", key_of("module", "function", F.col("role"), "a", "name").alias("key"), F.col("b").alias("call"), F.col("c").alias("pos"), (F.col("line") == 1).alias("guarded"))
    hit = given.join(ends, ["module", "function", "call"]).where("pos = -2 OR array_contains(positions, pos)")
    proofs = of(facts, "prefix").where("role = 'arg'").select("module", "function", F.col("a").alias("call"), F.col("b").alias("pos"), url_proof(F.col("text")).alias("proof")).where("proof IS NOT NULL")
    hit = hit.join(proofs, ["module", "function", "call", "pos"], "left").where("rule <> 'open-redirect' OR proof IS NULL").withColumn("guarded", F.col("guarded") | F.coalesce((F.col("rule") == "ssrf") & F.col("proof").isin("path", "origin"), F.lit(False)))
    found = hit.join(state, "key").where(F.col("bits").bitwiseAND(F.col("harm")) != 0)
    if not (of(facts, "allowed").isEmpty() and of(facts, "decorator").join(F.broadcast(models.authorizing_table(spark)), F.col("text") == F.col("symbol")).isEmpty()):
        tested = of(facts, "allowed").select("module", "function", F.col("a").alias("call"), F.lit(True).alias("tested")).distinct()
        held = written(covered_functions(facts, calls, lines), "covered").withColumn("held", F.lit(True))
        found = found.join(tested, ["module", "function", "call"], "left").join(held, ["module", "function"], "left")
        found = found.withColumn("guarded", F.col("guarded") | F.coalesce("tested", "held", F.lit(False)))
    return found.groupBy("path", "module", "function", "line", "col", "symbol", "rule", "severity").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.when(F.bool_and("guarded"), "hotspot").otherwise("vulnerability").alias("verdict"))


def reported_calls(facts: DataFrame) -> DataFrame:
    """One row per call that a rule reports as it stands: path, module, function, line, col, symbol, rule, severity."""
    spark = facts.sparkSession
    table = models.call_table(spark)
    calls = of(facts, "call").select("path", "module", "function", F.col("a").alias("call"), F.col("text").alias("symbol"), "line", "col").join(F.broadcast(table), "symbol")
    args = of(facts, "argument").select("module", "function", F.col("a").alias("call"), "b", "role", "name", "text")
    args = args.join(calls.select("module", "function", "call").distinct(), ["module", "function", "call"], "left_semi").groupBy("module", "function", "call").agg(
        F.map_from_entries(F.collect_list(F.when((F.col("role") == "keyword") & F.col("text").isNotNull(), F.struct("name", "text")))).alias("kw"),
        F.map_from_entries(F.collect_list(F.when((F.col("role") == "arg") & F.col("text").isNotNull(), F.struct("b", "text")))).alias("pos"),
        F.collect_set(F.when(F.col("role") != "arg", F.col("name"))).alias("given"))
    both = calls.join(args, ["module", "function", "call"], "left").withColumns({
        "kw": F.coalesce("kw", F.create_map().cast("map<string,string>")), "pos": F.coalesce("pos", F.create_map().cast("map<bigint,string>")), "given": F.coalesce("given", F.array().cast("array<string>"))})
    holds = F.lit(False)
    for rule, (_, _, condition) in models.CALLS.items():
        holds = F.when(F.col("rule") == rule, F.expr(condition)).otherwise(holds)
    return both.where(holds).select("path", "module", "function", "line", "col", "symbol", "rule", "severity")


def check(files: DataFrame) -> DataFrame:
    """The whole check of a project's files (path, text): path, line, rule, severity, symbol of every finding, and one row (line
    null) for each file that could not be analysed."""
    from .tables import facts as facts_of

    facts = facts_of(files, models.prefixes(), nodes=False, kinds=("file", "argument", *FLOW_KINDS))
    cols = ["path", "line", "rule", "severity", "symbol"]
    bad = of(facts, "file").where("name <> 'analysed'").select("path", F.col("line"), F.col("name").alias("rule"), F.lit("info").alias("severity"), F.lit("").alias("symbol"))
    return flows(facts).select(*cols).unionByName(reported_calls(facts).select(*cols)).unionByName(bad).distinct()
