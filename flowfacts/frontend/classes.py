"""Classes of a project: whose methods a call means, and entry points and untrusted attributes by base class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfacts.operators import hierarchy
from flowfacts.operators.models import prefixes
from flowfacts.operators.tables import written

from . import models
from .tables import of


def ancestors(facts: DataFrame) -> DataFrame:
    """(class, place, ancestor, own) of all classes, by symbol; a written table. Bases that are no known symbol are left out."""
    classes = of(facts, "class").select(F.col("text").alias("class"))
    bases = of(facts, "base").where("text <> ''").select(F.col("name").alias("class"), F.col("a").alias("position"), F.col("text").alias("base"))
    return written(hierarchy.ancestors(classes, bases), "ancestors")


def methods(facts: DataFrame) -> DataFrame:
    """(owner, member, module, function) of the methods that classes define."""
    own = of(facts, "function").where("text <> '' AND name = 'method'").select("module", "function", F.concat_ws(".", "module", "text").alias("owner"), F.substring_index("function", ".", -1).alias("member"))
    return own.groupBy("owner", "member").agg(F.min_by(F.struct("module", "function"), "function").alias("f")).select("owner", "member", "f.*")


def inherited(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(symbol, means): for symbols of calls that name a member of a class (or make an object of one) which it does not define
    itself, the member of the first ancestor that does; of an ancestor from outside if none in the project does."""
    symbols = of(facts, "call").where("text <> ''").select(F.col("text").alias("symbol")).distinct()
    classes = lines.where("place = 0").select("class")
    asked = symbols.select("symbol", F.regexp_replace("symbol", r"\.[^.]*$", "").alias("class"), F.substring_index("symbol", ".", -1).alias("member"))
    made = symbols.select("symbol", F.col("symbol").alias("class"), F.lit("__init__").alias("member"))
    found = hierarchy.members(asked.unionByName(made).join(classes, "class", "left_semi"), lines, methods(facts).select("owner", "member"))
    return found.withColumn("holder", F.coalesce("owner", "outside")).where("holder IS NOT NULL AND holder <> class").select("symbol", F.concat_ws(".", "holder", "member").alias("means")).where("NOT (endswith(means, '.__init__') AND startswith(means, 'builtins.'))")


def of_base(lines: DataFrame) -> DataFrame:
    """(class, base, methods, attributes, parameters): classes below a base of the models."""
    table = models.base_table(lines.sparkSession)
    return lines.join(F.broadcast(table), F.col("ancestor") == F.col("base")).select("class", "base", "methods", "attributes", "parameters")


def entry_points(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(module, function, base): methods that a library calls, as their class has one of its bases among its ancestors."""
    own = methods(facts).join(of_base(lines), F.col("owner") == F.col("class"))
    return own.where("parameters AND array_contains(methods, member)").select("module", "function", "base").distinct()


def attributes(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(module, function, a, name, source): reads of attributes that hold untrusted values by base class (in-ports of kind field)."""
    read = of(facts, "flow").where("role = 'field'").select("module", "function", "a", "name").distinct()
    read = read.withColumns({"class": F.concat_ws(".", "module", F.regexp_replace("name", r"\.[^.]*$", "")), "attribute": F.substring_index("name", ".", -1)})
    return read.join(of_base(lines), "class").where("array_contains(attributes, attribute)").select("module", "function", "a", "name", F.concat_ws(".", "base", "attribute").alias("source")).distinct()


def shared_fields(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, into) of fields: an attribute of a class and the one of the same name of an ancestor are one, both ways."""
    flow = of(facts, "flow")
    named = flow.where("role = 'field'").select("module", "name").unionByName(flow.where("text = 'field'").select("module", F.col("more").alias("name"))).distinct()
    held = named.select(F.concat_ws(".", "module", F.regexp_replace("name", r"\.[^.]*$", "")).alias("class"), F.substring_index("name", ".", -1).alias("attribute"), F.concat_ws("|", "module", F.lit("field"), "name").alias("key"))
    above = held.join(lines.where("own AND place > 0"), "class").select(F.col("ancestor").alias("class"), "attribute", F.col("key").alias("below"))
    both = above.join(held, ["class", "attribute"])
    return both.select("key", F.col("below").alias("into")).unionByName(both.select(F.col("below").alias("key"), F.col("key").alias("into"))).distinct()


def sources(calls: DataFrame) -> DataFrame:
    """(module, function, a, source): calls that mean, by inheritance, something untrusted."""
    table = models.source_table(calls.sparkSession)
    found = calls.where("symbol <> named").withColumn("prefix", F.explode(prefixes(F.col("symbol"), 1))).join(F.broadcast(table), "prefix")
    return found.select("module", "function", "a", F.col("symbol").alias("source")).distinct()
