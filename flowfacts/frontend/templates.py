"""Which templates escape all they print, in whatever they extend and include.

Every file is read once into items (``markup``): runs of text and values as functions of the place in the markup, and calls of
blocks, of a parent's block, and of other templates. A chain is a file with all it extends; a block means its definition nearest
the chain's start. The function of a block, a chain or a template's name composes what it holds in order, and the functions of all
are the least solution of these equations: what harms is found in rounds from the files that hold it, also around cycles of
includes, and a template that nothing refutes escapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfacts.operators.lattice import solve
from flowfacts.operators.tables import dealt, joined, written

from . import markup
from .tables import parallel

ITEMS = "path string, name string, block string, place int, kind string, ref string, optional boolean, f array<long>"
#: A setting that turns escaping off for all templates of a project.
OFF = r"""["']?autoescape["']?\s*[:=]\s*False\b"""


def names(files: DataFrame) -> DataFrame:
    """(path, name, text) of template files (path, text): those below a folder ``templates``, by their path behind it; a file below
    two such folders has two names."""
    parts = F.split("path", "/")
    at = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.element_at(parts, n) == "templates")
    inside = files.where(F.col("path").contains("templates/") & ~F.col("path").endswith(".py"))
    return inside.select("path", "text", F.explode(F.transform(at, lambda n: F.array_join(F.slice(parts, n + 1, F.size(parts)), "/"))).alias("name"))


def items(files: DataFrame) -> DataFrame:
    """ITEMS of template files, read once in parallel; a file without items has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("block", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("optional", pa.bool_()), ("f", pa.list_(pa.int64()))])
        for batch in batches:
            for path, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pylist([{"path": path, "name": name, **item} for item in markup.items(text)], schema)

    return written(parallel(names(files).select("path", "name", "text"), "path").mapInArrow(run, ITEMS), "template-items")


def chains(files: DataFrame, held: DataFrame) -> DataFrame:
    """(chain, level, path, name): each file (path, name) as level 0 of its chains, then what it extends, and so on. A name that
    several files have gives several chains. A chain that comes back to a file, or extends a name that no file has, ends with a
    null path."""
    extends = held.where("kind = 'extends'").groupBy("path", "name").agg(F.min_by("ref", "place").alias("extends"))
    size = files.count()
    link = written(joined(files.select("path", "name"), extends, size, ["path", "name"], "left"), "links")
    front = written(link.select(F.concat_ws(":", "path", "name").alias("chain"), F.array(F.struct("path", "name")).alias("line"), "extends"), "chains")
    done = front.where("extends IS NULL").select("chain", "line")
    while True:
        open_ = front.where("extends IS NOT NULL")
        if open_.isEmpty():
            break
        up = link.select(F.col("path").alias("_path"), F.col("name").alias("extends"), F.col("extends").alias("_next"))
        more = joined(open_, up, size, ["extends"], "left")
        again = F.array_contains(F.transform("line", lambda x: x["path"]), F.col("_path"))
        path = F.when(~F.coalesce(again, F.lit(False)), F.col("_path"))
        several = F.when(F.count("*").over(Window.partitionBy("chain")) > 1, F.concat_ws(">", "chain", "_path")).otherwise(F.col("chain"))
        front = written(more.select(several.alias("chain"), F.array_append("line", F.struct(path.alias("path"), F.col("extends").alias("name"))).alias("line"), F.when(path.isNotNull(), F.col("_next")).alias("extends")), "chains")
        done = done.unionByName(front.where("extends IS NULL").select("chain", "line"))
    return written(done.select("chain", F.posexplode("line").alias("level", "x")).select("chain", "level", "x.path", "x.name"), "chains")


def composed(first: Column, then: Column) -> Column:
    """The function that applies one after the other: harm adds up, ends are followed."""
    bad = F.lit(markup.BAD)
    states = F.sequence(F.lit(0), F.lit(len(markup.STATES) - 1))

    def follow(ends: Column) -> Column:
        reached = F.filter(states, lambda s: F.getbit(ends, s) == 1)
        return F.aggregate(reached, ends.bitwiseAND(bad), lambda acc, s: acc.bitwiseOR(F.get(then, s)))

    return F.transform(first, follow)


def verdicts(files: DataFrame) -> DataFrame:
    """(name, escapes) of every template of a project's files (path, text): whether nothing it prints, extends or includes can print
    a value unescaped, whichever of its files is meant. False for all where a Python file of the project turns escaping off."""
    count = len(markup.STATES)
    identity, harm, none = ([1 << n for n in range(count)], [1 << n | markup.BAD for n in range(count)], [0] * count)

    def constant(f: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("long") for x in f])

    own = written(names(files).select("path", "name"), "templates")
    held = items(files)
    lines = chains(own, held)
    size = max(own.count(), held.count(), lines.count())
    bodies = joined(lines.where("path IS NOT NULL"), held.where("kind <> 'extends'"), size, ["path", "name"])
    defined = bodies.where("kind = 'block'").select("chain", "level", F.col("ref").alias("block")).distinct()
    top = lines.groupBy("chain").agg(F.max("level").alias("_top"), F.max_by("path", "level").isNull().alias("_lost"))
    # what is printed: the last level's own items, and of each level those in blocks
    printed = joined(bodies, top, size, ["chain"]).where("NOT _lost AND (block <> '' OR level = _top)")
    unit = F.concat_ws("|", F.lit("unit"), "chain", "level", "block")
    calls = printed.where("kind IN ('block', 'super')").select("chain", "level", "block", "place", "kind", F.col("ref"))
    over = joined(calls, defined.withColumnsRenamed({"level": "_at", "block": "ref"}), size, ["chain", "ref"]).where("kind = 'block' OR _at > level").select("chain", "level", "block", "place", "ref", "_at")
    nearest = over.groupBy("chain", "level", "block", "place", "ref").agg(F.min("_at").alias("_at"))
    called = nearest.select(unit.alias("equation"), "place", F.concat_ws("|", F.lit("unit"), "chain", "_at", "ref").alias("operand"))
    included = printed.where("kind = 'include'").select(unit.alias("equation"), "place", F.concat_ws("|", F.lit("name"), "ref").alias("operand"))
    operands = written(called.unionByName(included), "template-calls")
    filled = joined(printed.withColumn("equation", unit), operands.select("equation", "place", F.lit(True).alias("calls")), size, ["equation", "place"], "left")
    # a block or parent's block that no level defines is empty
    filled = filled.withColumn("f", F.when(F.col("calls"), F.lit(None)).otherwise(F.coalesce("f", constant(identity))))
    ordered = F.array_sort(F.collect_list(F.struct("place", "optional", "f")))
    equations = dealt(filled, size, "equation").groupBy("equation").agg(ordered.alias("items")).withColumn("variable", F.col("equation"))
    # files without items, blocks without items, lost chains, names of no file
    empty = joined(lines, top, size, ["chain"]).where("level = _top").select("chain", "level", "_lost")
    units = defined.select(unit.alias("variable"), F.lit(False).alias("_lost")).unionByName(empty.select(F.concat_ws("|", F.lit("unit"), "chain", "level", F.lit("")).alias("variable"), "_lost"))
    bare = joined(units, equations.select("variable"), size, ["variable"], "left_anti").select("variable", F.when(F.col("_lost"), constant(harm)).otherwise(constant(identity)).alias("f"))
    absent = joined(included.select(F.col("operand").alias("variable")).distinct(), own.select(F.concat_ws("|", F.lit("name"), "name").alias("variable")), size, ["variable"], "left_anti").withColumn("f", constant(harm))
    # a name is each of the chains that begin with one of its files
    starts = joined(lines.where("level = 0").select("chain", "name"), top, size, ["chain"]).select("chain", F.concat_ws("|", F.lit("name"), "name").alias("variable"), F.concat_ws("|", F.lit("unit"), "chain", "_top", F.lit("")).alias("operand"))
    named = starts.select(F.concat_ws("|", F.lit("start"), "chain").alias("equation"), "variable", F.lit(None).cast("array<struct<place:int,optional:boolean,f:array<bigint>>>").alias("items"))
    operands = operands.unionByName(starts.select(F.concat_ws("|", F.lit("start"), "chain").alias("equation"), F.lit(0).alias("place"), "operand"))

    def through(acc: Column, item: Column) -> Column:
        called = F.coalesce(F.col("states")[item["place"]]["f"], constant(none))
        f = F.coalesce(item["f"], F.when(item["optional"], F.zip_with(called, constant(identity), lambda a, b: a.bitwiseOR(b))).otherwise(called))
        return composed(acc, f)

    value = F.when(F.col("items").isNull(), F.col("states")[F.lit(0)]["f"]).otherwise(F.aggregate("items", constant(identity), through))
    project = F.lit("").alias("project")
    equations = equations.select(project, "equation", "variable", "items").unionByName(named.select(project, "equation", "variable", "items"))
    # what calls nothing is known at once; what calls is evaluated first with nothing known of what it calls
    first = equations.where("items IS NOT NULL").withColumn("states", F.create_map().cast("map<int,struct<f:array<bigint>>>")).select("project", "variable", value.alias("f"))
    seeds = first.unionByName(bare.unionByName(absent).select(project, "variable", "f"))
    found = solve(seeds, equations, operands.select(project, "equation", "place", "operand"), {"f": value}, {"f": "each_bit_or"}, ["project"])
    harmed = found.where("startswith(variable, 'name|')").select(F.substring("variable", 6, 1 << 30).alias("name"), F.col("f")[0].bitwiseAND(F.lit(markup.BAD)).alias("bad"))
    off = files.where(F.col("path").endswith(".py") & F.col("text").rlike(OFF)).select(F.lit(True).alias("off")).limit(1)
    return joined(own.select("name").distinct(), harmed, size, ["name"], "left").select("name", ((F.coalesce("bad", F.lit(0)) == 0) & F.lit(off.isEmpty())).alias("escapes"))
