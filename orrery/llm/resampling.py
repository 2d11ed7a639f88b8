"""Importance resampling towards a target distribution (operator 11), with Spark expressions only.

Texts become arrays of n-grams, and these become buckets by crc32. Grouped
counts of the buckets in the source and in the target give each bucket a gain,
the floored log ratio of its smoothed shares. The gains, one row for each
bucket, are sent to all tasks and joined to the exploded buckets; a document's
weight is the floored mean of its gains. With Gumbel noise from a hash of the id
the highest weights are a draw without replacement. Ranks come from a sort by
ranges and the ranges' sizes.

The buckets are written once, in two bytes each, so that texts are read once;
a document's gains are added up where they are exploded, so that what moves is a
row for each document and task.

Defined results: null text has no words; a text without features weighs 0; texts
of any length are taken whole; a null id counts as the empty text in the noise,
and as the smallest in ties; repeated rows are drawn each; rows equal in score
and id are ranked one after another; documents under LEAST_WORDS words are
weighed, but not drawn; an empty target gives gains from the source alone, an
empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import discard, stored
from orrery.operators.ranking import numbered

BUCKETS = 10_000
GRAMS = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: What is no part of a word, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() is faster, but right for ASCII texts alone, as it changes other letters as well.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def grams(own: Column, most: int) -> Column:
    """All runs of 1 to `most` words, joined by one space."""
    runs = [own]
    for n in range(2, most + 1):
        longer = F.zip_with(runs[-1], F.slice(own, n, F.greatest(F.size(own), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.slice(longer, 1, F.greatest(F.size(own) - n + 1, F.lit(0))))
    return F.concat(*runs)


def bucketed(docs: DataFrame, text_col: str, buckets: int, most: int) -> DataFrame:
    """docs' other columns with n_words and each feature's bucket."""
    own = docs.withColumn("__words", words(F.col(text_col))).drop(text_col)
    found = F.transform(grams(F.col("__words"), most), lambda g: (F.crc32(g) % buckets).cast("int"))
    return own.select(*[c for c in own.columns if c != "__words"], F.size("__words").alias("__n_words"), found.alias("__buckets"))


def counts(of: DataFrame, name: str) -> DataFrame:
    """(bucket, name): at most a row for each bucket; the exploded rows are counted before they move."""
    return of.select(F.explode("__buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of bucketed tables, for the buckets of the source. `buckets` rows at most."""
    s, t = stored(counts(source, "s"), "source-counts"), stored(counts(target, "t"), "target-counts")
    all_s, all_t = (float(x.agg(F.sum(x.columns[1])).first()[0] or 0) for x in (s, t))
    ratio = (F.coalesce("t", F.lit(0)) + 1.0) * F.lit(all_s + buckets) / ((F.col("s") + 1.0) * F.lit(all_t + buckets))
    out = stored(s.join(t, "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")), "gains")
    discard(s, t)
    return out


def noise(id_col: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel draw, from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most: int = GRAMS) -> DataFrame:
    """(row, n_words, n_features, weight) and docs' columns but the text, one row for each row of docs."""
    rows = stored(bucketed(docs.withColumn("__row", F.monotonically_increasing_id()), text_col, buckets, most), "buckets")
    aim = bucketed(target.select(text_col), text_col, buckets, most)
    gain = gains(rows, aim, buckets)
    each = rows.select("__row", F.explode("__buckets").alias("bucket"))
    total = each.join(F.broadcast(gain), "bucket").groupBy("__row").agg(F.sum("gain").alias("__sum"))
    n = F.size("__buckets").cast("long")
    out = stored(rows.withColumn("n_features", n).drop("__buckets").join(total, "__row", "left")
                 .withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(__sum - pmod(__sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")).drop("__sum"), "weights")
    discard(rows, gain)
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, most: int = GRAMS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of docs; rank is null where it isn't drawn.

    Of the documents with at least `least_words` words `percent` in a hundred are drawn, those of the highest scores.
    """
    own = weighed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), target.select(F.col(text_col).alias("text")), "text", buckets, most)
    own = own.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    fit = F.col("__n_words") >= least_words
    n = own.filter(fit).count()
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(own.filter(fit).withColumn("__down", -F.col("score")), "__down", "doc_id", "__row", column="rank")
    drawn = F.when(F.col("rank") < n * percent // 100, F.col("rank") + 1).cast("long").alias("rank")
    return ranked.select(*columns, drawn).unionByName(own.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
