"""Comments that allow findings: ``# flowfacts-allow`` for every rule of its line, ``# flowfacts-allow: rule-a, rule-b -- why`` for some.

A text is cut by one pattern into its strings, comments and line ends, and a running count of line ends gives each comment its
line, all in column expressions. A string that is not closed ends with its line, or with the text if its quotes are three; so
files that don't parse have comments, too, and what stands in a string never allows anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "flowfacts-allow"
END = r"\r\n|\r|\n"


def _three(quote: str) -> str:
    """Three quotes, then anything but them (or escaped), to three quotes or the end of the text."""
    return rf"{quote * 3}[^{quote}\\]*+(?:(?:\\[\s\S]|{quote}{{1,2}}(?!{quote})|\\\z)[^{quote}\\]*+)*+(?:{quote * 3}|{quote}{{0,2}}\z)"


def _one(quote: str) -> str:
    """One quote to the next that is not escaped, or to the end of the line."""
    return rf"{quote}[^{quote}\\\r\n]*+(?:\\(?:{END}|[\s\S]|\z)[^{quote}\\\r\n]*+)*+{quote}?"


#: Pieces of a Python text that matter, the longer kinds of quotes first.
PIECE = "|".join([*map(_three, "\"'"), *map(_one, "\"'"), r"#[^\r\n]*+", END])
#: A comment that allows: nothing but spaces before the word, then the end, a reason, or a colon with rules.
ALLOW = rf"^#\s*{WORD}(?=\s|:|$)"
RULE = r"[A-Za-z][A-Za-z0-9_-]*"


def comments(text: Column, like: str = "") -> Column:
    """array<struct<line, comment>> of the comments of a text that match a pattern, in order."""
    pieces = F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1))
    none = F.array().cast("array<struct<line:bigint,comment:string>>")

    def step(acc: Column, piece: Column) -> Column:
        found = F.struct(acc["line"].alias("line"), piece.alias("comment"))
        return F.when(F.startswith(piece, F.lit("#")), F.struct(acc["line"].alias("line"), F.when(piece.rlike(like), F.array_append(acc["found"], found)).otherwise(acc["found"]).alias("found"))).otherwise(
            F.struct((acc["line"] + F.size(F.split(piece, END)) - 1).alias("line"), acc["found"].alias("found")))

    return F.aggregate(pieces, F.struct(F.lit(1).cast("long").alias("line"), none.alias("found")), step, lambda acc: acc["found"])


def suppressions(files: DataFrame) -> DataFrame:
    """(path, line, rules) of files (path, text); rules is null where a comment allows all. Several comments of a line add up.
    A comment with a colon and no rules allows nothing; null texts have no comments. Only files that hold the word are scanned."""
    held = files.where(F.contains("text", F.lit(WORD))).select("path", F.explode(comments(F.col("text"), ALLOW)).alias("c"))
    rest = F.regexp_replace(F.regexp_replace("c.comment", ALLOW, ""), r"\s--\s.*$", "")
    rules = F.when(F.startswith(F.trim(rest), F.lit(":")), F.regexp_extract_all(rest, F.lit(f"({RULE})"), F.lit(1)))
    return held.select("path", F.col("c.line").alias("line"), rules.alias("rules"))
