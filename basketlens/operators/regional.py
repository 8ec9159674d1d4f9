"""Do labels separate vectors? Centroids, separation and Mantel tests, cosine and TF-IDF in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.inference import draw, hash_cell
from basketlens.operators.ranking import numbered, range_cell
from basketlens.operators.vocabulary import dealt


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, i, v): mean of each place of the vectors (id, label, vec)."""
    long = vectors.select("label", F.posexplode("vec").alias("i", "v"))
    return long.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))


def cosine_pairs(long: DataFrame, key: str) -> DataFrame:
    """(a, b, distance), a < b, of a few vectors, such as centroids, in long form (key, i, v); zero vectors have norm 1; within [0, 2]."""
    norms = long.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    x, y = long.select(F.col(key).alias("a"), "i", F.col("v").alias("va")), long.select(F.col(key).alias("b"), "i", F.col("v").alias("vb"))
    dots = x.join(y, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    unit = F.when(F.col("n") == 0, 1.0).otherwise(F.col("n"))
    d = dots.join(norms.select(F.col(key).alias("a"), unit.alias("na")), "a").join(norms.select(F.col(key).alias("b"), unit.alias("nb")), "b")
    return d.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.col("dot") / (F.col("na") * F.col("nb")))).alias("distance"))


def relabelled(labels: DataFrame, reps: int, stream: str = "separation") -> DataFrame:
    """(rep, id, label): labels shuffled, by ranks of hashes; rep 0 is as observed."""
    base = labels.select("id", "label")
    slots = numbered(base, [], ["id"], range_cell(base, "id")).select("place", "label")
    drawn = base.select("id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("h", draw(stream, F.col("rep"), F.col("id")))
    drawn = numbered(drawn, ["rep"], ["h", "id"], hash_cell(F.col("h")))
    return drawn.join(slots, "place").select("rep", "id", "label").unionByName(base.select(F.lit(0).alias("rep"), "id", "label"))


def separation(vectors: DataFrame, reps: int) -> DataFrame:
    """(rep, gap) of vectors (id, label, vec): mean cosine distance between labels less mean within, observed (rep 0) and shuffled.

    Sums of unit vectors give the means: over all pairs of a set the dot products add up to
    (|sum|^2 - number of vectors) / 2. So no pair is ever made. A zero vector is at distance 1 to all.
    """
    v = vectors.select("id", "label", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    unit = v.withColumn("n", F.when(norm == 0, 1.0).otherwise(norm)).select("id", "label", F.when(norm == 0, 0).otherwise(1).alias("one"), F.transform("vec", lambda x: x / F.col("n")).alias("u"))
    drawn = relabelled(unit, reps).join(unit.drop("label"), "id")
    width = F.size("u")
    per = drawn.groupBy("rep", "label").agg(F.count("*").alias("m"), F.sum("one").alias("ones"), F.max(width).alias("d"))
    sums = drawn.select("rep", "label", F.posexplode("u").alias("i", "x")).groupBy("rep", "label", "i").agg(F.sum("x").alias("x"))
    inner = sums.groupBy("rep", "label").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = sums.groupBy("rep", "i").agg(F.sum("x").alias("x")).groupBy("rep").agg(F.sum(F.col("x") * F.col("x")).alias("q_all"))
    w = per.join(inner, ["rep", "label"]).groupBy("rep").agg(
        F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum((F.col("q") - F.col("ones")) / 2).alias("dots"), F.sum("m").alias("all"), F.sum("ones").alias("ones")
    )
    x = w.join(whole, "rep")
    pairs, dots = F.col("all") * (F.col("all") - 1) / 2, (F.col("q_all") - F.col("ones")) / 2
    within, between = 1 - F.try_divide("dots", "pairs"), 1 - F.try_divide(dots - F.col("dots"), pairs - F.col("pairs"))
    return x.select("rep", (between - within).alias("gap"))


def one_sided(null: DataFrame, value: str) -> DataFrame:
    """(observed, p) from rep 0 and the others: (1 + those that reach it) / (1 + all)."""
    seen = F.max(F.when(F.col("rep") == 0, F.col(value)))
    obs = F.broadcast(null.agg(seen.alias("observed")))
    d = null.where("rep > 0").crossJoin(obs)
    return d.groupBy("observed").agg(((1 + F.count_if(F.col(value) >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))


def mantel(left: DataFrame, right: DataFrame, reps: int) -> DataFrame:
    """(rep, r): correlation of two distance lists (a, b, distance), rows and columns of one shuffled together. Lists over different ids are refused."""
    named = lambda df: df.select(F.col("a").alias("id")).union(df.select("b")).distinct()
    if named(left).join(named(right), "id", "left_anti").limit(1).count() or named(right).join(named(left), "id", "left_anti").limit(1).count():
        raise ValueError("the two lists of distances are over different ids")
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    moved = relabelled(ids.withColumn("label", F.col("id")), reps, "mantel")
    a, b = moved.select("rep", F.col("id").alias("a"), F.col("label").alias("ma")), moved.select("rep", F.col("id").alias("b"), F.col("label").alias("mb"))
    x = left.join(a, "a").join(b, ["rep", "b"]).select("rep", F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), F.col("distance").alias("x"))
    d = x.join(right.select("a", "b", F.col("distance").alias("y")), ["a", "b"])
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    cov = F.sum(F.col("x") * F.col("y")) - sx * sy / n
    vx, vy = F.sum(F.col("x") * F.col("x")) - sx * sx / n, F.sum(F.col("y") * F.col("y")) - sy * sy / n
    return d.groupBy("rep").agg(F.coalesce(F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx * vy))), F.lit(0.0)).alias("r"))


#: Words that are sent to every task with their document frequencies, and their greatest length; the others are joined.
FREQUENT, LONGEST = 200_000, 100


def term_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """(doc, token, tf) of texts (doc, text), in lower case: how often each match of a pattern occurs.

    Only texts are shuffled, to bring those of one doc together; their words are counted where they are then,
    in tasks that get no larger with the input.
    """
    words = dealt(texts, "doc", texts.sparkSession.sparkContext.defaultParallelism).select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0)).alias("token"))
    return words.where("token is not null").groupBy("doc", "token").agg(F.count("*").alias("tf"))


def term_weights(texts: DataFrame, pattern: str, least: int = 2) -> DataFrame:
    """(doc, token, w): raw counts times ln((1+n)/(1+df))+1 over tokens in ``least`` documents.

    Frequent words, which most rows have, find their document frequency without a shuffle; only rows of
    the others are joined.
    """
    tf = term_counts(texts, pattern)
    df = tf.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    frequent = df.orderBy(F.desc("df"), "token").limit(FREQUENT).where(F.length("token") <= LONGEST)
    n = F.broadcast(texts.where(F.lower("text").rlike(pattern)).agg(F.count_distinct("doc").alias("n")))
    known = tf.join(F.broadcast(frequent), "token")
    rare = tf.join(F.broadcast(frequent.select("token")), "token", "left_anti").join(df, "token")
    w = (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w")
    return known.crossJoin(n).select("doc", "token", w).unionByName(rare.crossJoin(n).select("doc", "token", w))


def tfidf(texts: DataFrame, pattern: str, least: int = 2) -> DataFrame:
    """(doc, token, weight): term_weights() of texts (doc, text) to length 1."""
    w = term_weights(texts, pattern, least)
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select("doc", "token", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_tops(texts: DataFrame, pattern: str, least: int = 2) -> DataFrame:
    """(doc, tokens, top): of tfidf(), how many tokens a document has and the greatest weight, without the rows."""
    w = F.col("w")
    return term_weights(texts, pattern, least).groupBy("doc").agg(F.count("*").alias("tokens"), (F.max(w) / F.sqrt(F.sum(w * w))).alias("top"))
