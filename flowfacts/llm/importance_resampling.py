"""Resampling towards a target distribution by hashed n-grams (operator 13).

Words of every text are exploded with their positions; over the positions of a document ``lead`` puts the following words
beside each, so a row yields its n-grams of every order. Their hashes are buckets. What all documents and all target texts
hold in each bucket gives the bucket's gain, gains are joined back to the n-grams and averaged per document, and a Gumbel
draw keyed by the document turns the averages into a sample without replacement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .conversation_repair import crc32_sql

ORDERS = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 25
SEED = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII that is no digit and no letter of lower case ends a word.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pieces_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with an empty one at an end where the text does not begin or end with a word."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART)


def grams(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """A row for each word of texts (r, text and others): its place's n-grams of each order as buckets b0, b1, ... (null behind
    the last word), without text. A text that begins with no word has one more row of nulls, so every text has a row.

    texts must be dealt by r: then nothing is shuffled here.
    """
    rest = [c for c in texts.columns if c not in ("r", "text")]
    words = texts.select("r", *rest, F.posexplode(pieces_of(F.col("text"))).alias("pos", "word")).where("word <> '' OR pos = 0")
    here = Window.partitionBy("r").orderBy("pos")
    made = [F.when(F.col("word") != "", F.col("word"))]
    for k in range(1, orders):
        made.append(F.concat(made[-1], F.lit(" "), F.lead("word", k).over(here)))
    return words.select("r", *rest, *[(F.crc32(g.cast("binary")) % buckets).cast("int").alias(f"b{k}") for k, g in enumerate(made)])


def counted(found: DataFrame, orders: int, name: str) -> DataFrame:
    """Occurrences of each bucket, all orders together."""
    each = [found.where(F.col(f"b{k}").isNotNull()).groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count("*").alias("n")) for k in range(orders)]
    return reduce(DataFrame.unionAll, each).groupBy("bucket").agg(F.sum("n").alias(name))


def gains(documents: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """One row per bucket (so at most ``buckets`` rows): floor(1000 ln of how much likelier it is in the target), of grams()."""
    s, t = counted(documents, orders, "s"), counted(target, orders, "t")
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = materialize(every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]), "held")
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))  # one row of sums


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a standard Gumbel draw) that depends on the id alone; of a null id on the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def placed(scored: DataFrame, order: list[Column], drawn: int, name: str = "rank") -> DataFrame:
    """scored with the place (from 1) in the order where it is at most drawn, else null. Rows are dealt by ranges and moved on
    by the rows of the ranges before, so no task sees all."""
    dealt = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampled")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    joined = dealt.join(F.broadcast(before), "part").withColumn("place", place)
    return joined.withColumn(name, F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("part", "before", "place")


def resample(documents: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED,
             key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, n_features, weight, score, rank (null unless drawn).

    Every row is a document of its own, rows that repeat an id or a text included; rows of one id have one Gumbel draw and,
    of equal score, stand in order of weight and features. Null and empty texts have no features, weight 0 and are never
    drawn (unless least_words is 0); a null id stands first among equal scores. Texts are read whole. An empty table gives no rows, an empty
    target gains that say how rare a bucket is. Other columns, whatever their names, are not read.

    Texts are dealt once, by row, and read once: explosion, window and hashes follow without another shuffle, and the hashes
    are written (about as large as the texts). What else is shuffled is counts of at most ``buckets`` buckets a task and a
    narrow row per document.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("r"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    aim = target.select(F.monotonically_increasing_id().alias("r"), F.col(target_text).cast("string").alias("text"))
    held = materialize(grams(rows.repartition("r"), orders, buckets), "grams")
    gain = materialize(gains(held, grams(aim.repartition("r"), orders, buckets), orders, buckets), "gains")
    valued = held
    for k in range(orders):
        valued = valued.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    n, total = (reduce(lambda a, b: a + b, [F.coalesce(f(f"g{k}"), F.lit(0)) for k in range(orders)]) for f in (F.count, F.sum))
    summed = valued.groupBy("r", "doc_id").agg(n.alias("n"), total.alias("sum"), F.count("b0").alias("n_words"))
    weight = F.when(F.col("n") > 0, (F.col("sum") - F.pmod("sum", "n")) / F.col("n")).otherwise(0).cast("long")
    scored = summed.select("doc_id", F.col("n").alias("n_features"), weight.alias("weight"), (weight + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("ok"))
    scored = materialize(scored, "scored")
    drawn = per_cent * scored.where("ok").count() // 100
    order = [F.col("ok").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()]
    return placed(scored, order, drawn).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` drawn towards the texts of ``benchmark``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _grams_sql(table: str, rows: str) -> str:
    return f"""
{table}_words AS (SELECT r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM {rows}),
{table}_grams AS (SELECT r, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM {table}_words)"""


ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), aim AS (SELECT row_number() OVER () AS r, text FROM benchmark),{_grams_sql("doc", "doc")},{_grams_sql("aim", "aim")},
bucket AS (SELECT gram, {crc32_sql("gram")} % {BUCKETS} AS bucket FROM (SELECT gram FROM doc_grams UNION SELECT gram FROM aim_grams)),
held AS (SELECT bucket, count(*) AS s FROM doc_grams JOIN bucket USING (gram) GROUP BY bucket), aimed AS (SELECT bucket, count(*) AS t FROM aim_grams JOIN bucket USING (gram) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM held) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM aimed) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM held FULL JOIN aimed USING (bucket)),
weights AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight, count(*) AS n FROM doc_grams JOIN bucket USING (gram) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) >= {LEAST_WORDS} AS ok,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc JOIN doc_words USING (r) LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY ok DESC, score DESC, doc_id NULLS FIRST, weight, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PER_CENT} * (SELECT count(*) FROM scored WHERE ok) // 100 THEN place END AS rank FROM placed
"""
