"""What a call tells of the conditions under which an advisory holds, in three values.

A condition is met, pending (the call does not tell) or contradicted (the call can't do harm). Conditions of an entry point are
read in order, and the first contradicted one ends the reading; a call is ruled out of an advisory only if every entry point
that it matches is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfacts.frontend.tables import of
from flowfacts.frontend.taint import url_proof
from flowfacts.operators.models import suffixes
from flowfacts.operators.tables import if_small

MET, PENDING, CONTRADICTED = "met", "pending", "contradicted"
#: A condition. kind: argument, keyword_name, host, sequence, or semantic (which no call can tell).
CONDITION = "struct<kind:string,text:string,argument:string,position:int,values:array<string>,default:boolean,present:boolean,method:string>"
#: What a call gives: values are symbols or constants as Python writes them, null where they are not known.
ARGUMENTS = "struct<positional:map<int,string>,keywords:map<string,string>,unpacked:boolean,keys_unpacked:boolean>"
#: Where an attacker's value is passed: a place, a keyword, the keys of a mapping, or any of both (unpacked).
PASSED = "array<struct<position:int,keyword:string>>"
PRIOR = f"array<struct<symbol:string,dominates:boolean,arguments:{ARGUMENTS}>>"
#: Keyword that stands for the names in an unpacked mapping.
KEYS = "**"


def _given(a: Column, argument: Column, position: Column) -> tuple[Column, Column, Column]:
    """(whether it is known if an argument is given, whether it is, its value)."""
    named = argument.isNotNull() & F.coalesce(F.map_contains_key(a["keywords"], F.coalesce(argument, F.lit(""))), F.lit(False))
    placed = position.isNotNull() & F.coalesce(F.map_contains_key(a["positional"], F.coalesce(position, F.lit(-1))), F.lit(False))
    unsure = a["unpacked"] & position.isNotNull() | a["keys_unpacked"] & argument.isNotNull()
    value = F.when(named, F.try_element_at(a["keywords"], argument)).when(placed, F.try_element_at(a["positional"], position))
    return named | placed | ~unsure, named | placed, value


def _argument(c: Column, a: Column) -> Column:
    """State of an argument condition: pending without arguments, or if they don't tell."""
    known, given, value = _given(a, c["argument"], c["position"])
    checkable = a.isNotNull() & (c["argument"].isNotNull() | c["position"].isNotNull())
    present = F.coalesce(c["present"], F.lit(False))
    affected = F.when(given, F.array_contains(c["values"], value)).otherwise(F.coalesce(c["default"], F.lit(False)))
    return F.when(~checkable | ~known, PENDING).when(present & given, MET).when(present, CONTRADICTED).when(given & value.isNull(), PENDING).when(affected, MET).otherwise(CONTRADICTED)


def _named(symbol: Column, method: Column) -> Column:
    return (symbol == method) | F.endswith(symbol, F.concat(F.lit("."), method))


def receives(condition: Column, passed: Column) -> Column:
    """Whether an attacker's value is passed as a condition's argument: by keyword, by place, or in something unpacked."""
    return F.exists(passed, lambda p: (p["keyword"].isNotNull() & (p["keyword"] == condition["argument"])) | (p["position"].isNotNull() & (p["position"] == condition["position"])) | (p["keyword"].isNull() & p["position"].isNull()))


def state_of(c: Column, a: Column, origin: Column, stays: Column, passed: Column, prior: Column) -> Column:
    """struct<state, passed, note> of one condition at a call.

    a: ARGUMENTS, or null; origin: the host that the text before an attacker's value fixes, or null; stays: whether the call
    follows no redirects; passed: PASSED; prior: PRIOR, earlier calls on the same object, null where they can't be followed.
    """
    value = F.try_element_at(a["keywords"], c["argument"])
    by_place = F.coalesce(value, F.try_element_at(a["positional"], c["position"]))
    keys = F.exists(passed, lambda p: p["keyword"] == KEYS)
    names = F.when(F.size(F.map_keys(a["keywords"])) > 0, F.array_join(F.array_sort(F.map_keys(a["keywords"])), ", "))
    keyword = F.when(keys, MET).when(a.isNull() | a["keys_unpacked"], PENDING).otherwise(CONTRADICTED)
    fixed = origin.isNotNull() & receives(c, passed)
    host = F.when(fixed & stays, CONTRADICTED).otherwise(PENDING)
    matching = F.filter(prior, lambda p: _named(p["symbol"], c["method"]))
    whole = (c["argument"].isNull() & c["position"].isNull())
    asked = F.transform(matching, lambda p: F.struct(F.when(whole, MET).otherwise(_argument(c, p["arguments"])).alias("state"), p["dominates"].alias("dominates")))
    first = F.exists(asked, lambda x: (x["state"] == MET) & x["dominates"])
    unsure = prior.isNull() | c["method"].isNull() | F.exists(asked, lambda x: x["state"] != CONTRADICTED) | (F.when(whole, F.lit(MET)).otherwise(_argument(c, a)) != CONTRADICTED)
    sequence = F.when(first, MET).when(F.coalesce(unsure, F.lit(True)), PENDING).otherwise(CONTRADICTED)
    kind = c["kind"]
    state = F.when(kind == "keyword_name", keyword).when(kind == "host", host).when(kind == "sequence", sequence).when(kind == "argument", _argument(c, a)).otherwise(PENDING)
    shown = F.when(kind == "keyword_name", names).when(kind == "host", F.concat(F.lit("'"), origin, F.lit("'"))).when((kind == "argument") & ~F.coalesce(c["present"], F.lit(False)), by_place)
    note = F.when((kind == "host") & fixed & ~stays, F.concat(F.lit("the host is fixed by '"), origin, F.lit("', but a redirect may lead elsewhere"))).otherwise(c["text"])
    return F.struct(state.alias("state"), shown.alias("passed"), note.alias("text"))


def checked(conditions: Column, *at: Column) -> Column:
    """struct<met, pending, contradicted, passed>: texts of the conditions in order up to the first contradicted one, which is
    null if none is. at: what ``state_of`` takes behind the condition."""
    states = F.transform(F.coalesce(conditions, F.array().cast(f"array<{CONDITION}>")), lambda c: state_of(c, *at))
    end = F.array_position(F.transform(states, lambda s: s["state"]), F.lit(CONTRADICTED))
    seen = F.when(end > 0, F.slice(states, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(states)
    last = F.when(end > 0, F.get(states, (end - 1).cast("int")))

    def texts(state: str) -> Column:
        return F.transform(F.filter(seen, lambda s: s["state"] == state), lambda s: s["text"])

    return F.struct(texts(MET).alias("met"), texts(PENDING).alias("pending"), last["text"].alias("contradicted"), last["passed"].alias("passed"))


def exploitable_through(attackers: Column, passed: Column) -> Column:
    """Whether an attacker's value is passed where it does harm. attackers: array<struct<argument, position, variadic>>; an empty
    one takes any argument, a variadic one every place from its own on."""
    def takes(x: Column) -> Column:
        return F.exists(passed, lambda p: (p["keyword"].isNull() & p["position"].isNull()) | (p["keyword"] == x["argument"]) | (p["position"] == x["position"]) | (F.coalesce(x["variadic"], F.lit(False)) & (p["position"] >= x["position"])))

    anything = attackers.isNull() | (F.size(attackers) == 0)
    return F.when(anything, F.size(passed) > 0).otherwise(F.coalesce(F.exists(attackers, takes), F.lit(False)))


def calls_of(facts: DataFrame) -> DataFrame:
    """(path, module, function, call, line, symbol, arguments, origin, stays, passed, prior) of calls of what is not the project's
    own, from fact tables: constants and symbols as values; origin where the text that an argument begins with fixes a host."""
    own = ["module", "function", "call"]
    calls = of(facts, "call").where("text <> ''").select("path", "module", "function", F.col("a").alias("call"), "line", F.col("text").alias("symbol"))
    symbols = of(facts, "symbol").select("module", "function", F.col("a").alias("value"), F.col("text").alias("named"))
    args = of(facts, "argument").select("module", "function", F.col("a").alias("call"), F.col("b").cast("int").alias("place"), F.col("c").alias("value"), "role", "name", "text").join(symbols, ["module", "function", "value"], "left").withColumn("shown", F.coalesce("text", "named"))
    given = args.groupBy(*own).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("role") == "arg", F.struct("place", "shown")))).alias("positional"), F.map_from_entries(F.collect_list(F.when(F.col("role") == "keyword", F.struct("name", "shown")))).alias("keywords"),
        F.bool_or((F.col("role") == "unpacked") & (F.col("name") == "*")).alias("unpacked"), F.bool_or((F.col("role") == "unpacked") & (F.col("name") == KEYS)).alias("keys_unpacked"),
        F.bool_or(F.col("name").isin("allow_redirects", "follow_redirects") & (F.col("text") == "False")).alias("stays"))
    fixed = of(facts, "prefix").where("c = 0").withColumn("proof", url_proof(F.col("text"))).where("proof IN ('origin', 'path')").select(
        "module", "function", F.col("a").alias("call"), F.struct(F.when(F.col("role") == "arg", F.col("b")).cast("int").alias("position"), F.when(F.col("role") == "keyword", F.col("name")).alias("keyword")).alias("p"), F.regexp_extract("text", r"^https?://[^/?#\\]+", 0).alias("origin"))
    fixed = fixed.groupBy(*own).agg(F.collect_set("p").alias("passed"), F.min("origin").alias("origin"))
    both = calls.join(given, own, "left").join(fixed, own, "left")
    arguments = F.struct(F.coalesce("positional", F.create_map().cast("map<int,string>")).alias("positional"), F.coalesce("keywords", F.create_map().cast("map<string,string>")).alias("keywords"), F.coalesce("unpacked", F.lit(False)).alias("unpacked"), F.coalesce("keys_unpacked", F.lit(False)).alias("keys_unpacked"))
    return both.select("path", *own, "line", "symbol", arguments.alias("arguments"), "origin", F.coalesce("stays", F.lit(False)).alias("stays"), F.coalesce("passed", F.array().cast(PASSED)).alias("passed"), F.lit(None).cast(PRIOR).alias("prior"))


def correlated(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """(call's columns, advisory, symbol, met, pending, contradicted, passed) of calls (symbol and what ``state_of`` reads) that match
    an entry point (advisory, symbol, conditions), by its whole name or a dotted end. entries are broadcast if they are few."""
    keyed = entries.select("advisory", F.col("symbol").alias("entry"), "conditions").withColumn("name", F.col("entry"))
    few = keyed.count()
    found = calls.withColumn("name", F.explode(suffixes(F.col("symbol")))).join(if_small(keyed, few), "name").drop("name")
    got = found.withColumn("_c", checked(F.col("conditions"), F.col("arguments"), F.col("origin"), F.col("stays"), F.col("passed"), F.col("prior")))
    return got.select(*calls.columns, "advisory", "entry", "_c.met", "_c.pending", "_c.contradicted", F.col("_c.passed").alias("shown"))


def decided(found: DataFrame, by: list[str]) -> DataFrame:
    """One row per call and advisory (by) over its entry points: 'ruled out' if all are contradicted, 'reached' if one has nothing
    pending, else 'review'."""
    alive = F.col("contradicted").isNull()
    return found.groupBy(*by).agg(F.count("*").alias("entries"), F.when(~F.bool_or(alive), "ruled out").when(F.bool_or(alive & (F.size("pending") == 0)), "reached").otherwise("review").alias("decision"))
