"""Package names, versions and specifiers as column expressions.

Name normalisation is PEP 503's; the operators are PEP 440's and Poetry's caret. Stars follow a looser reading than PEP 440:
``==1.2.*`` asks for the pieces as they are written, so ``1`` does not meet ``==1.0.*``, and ``!=1.2.*`` excludes 1.2 alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A clause: fixed operators of PEP 440 and the caret, then an operand that begins with a digit. Others are passed over.
CLAUSE = r"^(===|==|!=|<=|>=|~=|<|>|\^)\s*([0-9][0-9A-Za-z.*+!-]*)$"
#: Pieces too large for a long count as the largest one.
LARGEST = 2**63 - 1


def normalize(name: Column) -> Column:
    """PEP 503 name: runs of '-', '_' and '.' become one '-', letters lower case."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def parse(text: Column) -> Column:
    """array<long> of the leading digits of each dotted piece, up to the first piece that is not digits alone; [0] if none."""
    pieces = F.split(F.trim(text), r"\.")
    impure = F.array_position(F.transform(pieces, lambda p: p.rlike(r"^[0-9]+$")), F.lit(False))
    cut = F.when(impure == 0, pieces).otherwise(F.slice(pieces, 1, impure.cast("int")))
    digits = F.filter(F.transform(cut, lambda p: F.regexp_extract(p, r"^[0-9]+", 0)), lambda d: d != "")
    return F.when(F.size(digits) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(digits, lambda d: F.coalesce(d.try_cast("long"), F.lit(LARGEST))))


def _padded(a: Column, b: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.size(b) - F.size(a))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for version arrays of any lengths, missing pieces counting as 0."""
    x, y = _padded(a, b), _padded(b, a)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _bumped(v: Column, at: Column) -> Column:
    """v cut after position `at` (from 1), its last piece one higher."""
    return F.concat(F.slice(v, 1, at - 1), F.array(F.get(v, at - 1) + 1))


def _alternatives(spec: Column) -> Column:
    """array<string>: what stands between '||', blank ones left out; one blank alternative if there is no other."""
    found = F.filter(F.split(spec, r"\|\|"), lambda a: F.trim(a) != "")
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def _clauses(alternative: Column) -> Column:
    """array<string>: the clauses of an alternative that can be read."""
    return F.filter(F.transform(F.split(alternative, ","), lambda c: F.trim(c)), lambda c: c.rlike(CLAUSE))


def compiled(spec: Column) -> Column:
    """array (alternatives) of arrays (clauses) of struct<op, want, star, ceiling>: a specifier read once, to be met by many
    versions. ``ceiling`` is the first version too high for '~=' and '^'."""
    def clause(c: Column) -> Column:
        op, operand = F.regexp_extract(c, CLAUSE, 1), F.regexp_extract(c, CLAUSE, 2)
        want = parse(operand)
        first = F.array_position(F.transform(want, lambda p: p != 0), F.lit(True)).cast("int")
        ceiling = F.when(op == "~=", _bumped(want, F.greatest(F.lit(1), F.size(want) - 1))).when(op == "^", _bumped(want, F.when(first == 0, F.size(want)).otherwise(first)))
        return F.struct(op.alias("op"), want.alias("want"), operand.endswith(".*").alias("star"), ceiling.alias("ceiling"))

    return F.transform(_alternatives(spec), lambda a: F.transform(_clauses(a), clause))


def _meets_clause(version: Column, c: Column) -> Column:
    op, want = c["op"], c["want"]
    order = compare(version, want)
    return (
        F.when(op.isin("==", "==="), F.when(c["star"], F.slice(version, 1, F.size(want)) == want).otherwise(order == 0))
        .when(op == "!=", order != 0)
        .when(op == "<", order < 0).when(op == "<=", order <= 0).when(op == ">", order > 0).when(op == ">=", order >= 0)
        .otherwise((order >= 0) & (compare(version, c["ceiling"]) < 0))
    )


def meets(version: Column, alternatives: Column) -> Column:
    """Whether a version array meets a compiled specifier; one without readable clauses always holds."""
    return F.exists(alternatives, lambda a: F.forall(a, lambda c: _meets_clause(version, c)))


def satisfies(version: Column, spec: Column) -> Column:
    """Whether a version array meets any of the alternatives (||) of comma-joined clauses such as '>=1.2', '==1.*', '~=2.1'."""
    return meets(version, compiled(spec))


def _bounds(alternatives: Column) -> Column:
    """array<array<long>> of the versions that lower and exact clauses of a compiled specifier name."""
    lower = F.filter(F.flatten(alternatives), lambda c: c["op"].isin(">=", ">", "~=", "^", "==", "==="))
    return F.transform(lower, lambda c: c["want"])


def pinned(spec: Column) -> Column:
    """The version array that a specifier of one exact clause without a star pins, else null."""
    return F.when(spec.rlike(r"^\s*==[^,|]*$") & ~spec.rlike(r"\.\*\s*$"), parse(F.regexp_replace(spec, r"^\s*=+", "")))


def may_meet(pin: Column, declared: Column, vulnerable: Column) -> Column:
    """Whether a requirement may be a vulnerable version: its pin (version array or null) is one, or, without a pin, some
    version of 0 and the bounds that both compiled specifiers name meets both."""
    tried = F.concat(F.array(F.array(F.lit(0).cast("long"))), _bounds(declared), _bounds(vulnerable))
    return F.when(pin.isNotNull(), meets(pin, vulnerable)).otherwise(F.exists(tried, lambda v: meets(v, declared) & meets(v, vulnerable)))


def may_match(declared: Column, vulnerable: Column) -> Column:
    """may_meet for specifiers as text; one that pins a version is taken by its pin."""
    return may_meet(pinned(declared), compiled(declared), compiled(vulnerable))


def purl(name: Column, version: Column) -> Column:
    """Package URL; the version, an int array or null, is left out if null."""
    return F.concat(F.lit("pkg:pypi/"), normalize(name), F.coalesce(F.concat(F.lit("@"), F.array_join(version.cast("array<string>"), ".")), F.lit("")))


def osv_specifiers(events: Column) -> Column:
    """array<string>: a specifier for each vulnerable stretch of an OSV range's events (array<struct<introduced, fixed,
    last_affected>>): from an introduction, if it isn't 0, to the next fix or last affected version, or open."""
    def joined(low: Column, bound: Column) -> Column:
        return F.concat_ws(",", F.when(low.isNotNull() & (low != "0"), F.concat(F.lit(">="), low)), bound)

    def fold(acc: Column, e: Column) -> Column:
        bound = F.when(e["fixed"].isNotNull(), F.concat(F.lit("<"), e["fixed"])).when(e["last_affected"].isNotNull(), F.concat(F.lit("<="), e["last_affected"]))
        low = F.when(e["introduced"].isNotNull(), e["introduced"]).when(bound.isNull(), acc["low"])
        found = F.when(e["introduced"].isNull() & bound.isNotNull(), F.concat(acc["found"], F.array(joined(acc["low"], bound)))).otherwise(acc["found"])
        return F.struct(low.alias("low"), found.alias("found"))

    start = F.struct(F.lit(None).cast("string").alias("low"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.coalesce(events, F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>")), start, fold,
                       lambda acc: F.when(acc["low"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(joined(acc["low"], F.lit(None).cast("string"))))))
