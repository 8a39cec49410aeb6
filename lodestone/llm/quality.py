"""Quality rules whose cutoffs are chosen on labelled documents with exact binomial bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
#: Signals between 0 and 1, of which large values speak against a text.
SIGNALS = ("symbol_ratio", "upper_ratio", "exclaim_ratio", "dup_line_ratio", "repeat_ratio")
BINS = 100
MAX_FALSE_REJECTION = 0.05
CONFIDENCE = 0.95
LOSS = 20.0


def _repeated(words: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows are told apart by their 64-bit hashes;
    equal ones meet by sorting, so a text of n words takes n log n steps."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h) & (k + 1 < F.size(s)))
            return F.array_sort(F.transform(twice, lambda x: x.i))

        def total(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
                lambda a, x: F.struct((a.n + (x + 3 - F.greatest(x, a.end))).cast("long").alias("n"), (x + 3).alias("end")),
                lambda a: a.n,
            )

        many = F.transform(F.transform(F.array(pairs), positions), total)[0]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(many)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(F.transform(F.array(hashes), covered)[0])


def with_stats(docs: DataFrame) -> DataFrame:
    """docs and the column __q: a struct of counts of the whole text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.withColumn("__text", text).withColumn("__words", F.filter(F.split("__text", SPACE), lambda w: w != ""))
    a = a.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    return a.withColumn(
        "__q",
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            _repeated(F.col("__words")).alias("n_repeat_words"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.regexp_count("__text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count("__text", F.lit("!")).cast("long").alias("n_exclaim"),
        ),
    ).drop("__text", "__words", "__lines")


def _signals(q: str) -> dict[str, Column]:
    chars, words, lines = (F.greatest(F.col(f"{q}.{c}"), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    raw = {
        "symbol_ratio": F.col(f"{q}.n_symbols") / chars,
        "upper_ratio": F.col(f"{q}.n_upper") / chars,
        "exclaim_ratio": F.col(f"{q}.n_exclaim") / words,
        "dup_line_ratio": F.col(f"{q}.n_dup_lines") / lines,
        "repeat_ratio": F.col(f"{q}.n_repeat_words") / words,
    }
    return {k: F.least(v.cast("double"), F.lit(1.0)) for k, v in raw.items()}


def base_failed(q: str = "__q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def _bin(signal: Column) -> Column:
    return F.floor(signal * BINS).cast("int")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term; 1 where k is no less than n * p. At most
    ``level`` exactly where the Clopper-Pearson upper bound of k / n at that level is at most p."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct(
            F.when(j == 0, first).otherwise(a.log + F.log((n - j + 1) / F.greatest(j, F.lit(1)) * odds)).alias("log"),
            (a.sum + F.exp(F.when(j == 0, first).otherwise(a.log + F.log((n - j + 1) / F.greatest(j, F.lit(1)) * odds)))).alias("sum"),
        ),
        lambda a: F.least(a.sum, F.lit(1.0)),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE, loss: float = LOSS) -> DataFrame:
    """One row per stratum with a column for each signal: values whose bin is above it are rejected.

    stats: doc_id, the stratum and __q of all documents; labels: doc_id, quality (1 good, 0 bad). All
    labelled documents that the base rules keep are the holdout; a document with several labels counts
    with its best one. In each stratum and for each signal the bins are tested from the top down:
    the cutoff's false rejections among the good ones must have an exact binomial probability of at
    most (1 - confidence) / (strata * signals) under a rate of risk / signals (fixed-sequence testing
    within a chain, Bonferroni over chains). So with the given confidence no stratum loses more than
    ``risk`` of its good documents. Among the passed cutoffs the one with the largest (bad rejected -
    loss * good rejected) is taken, if that is above 0, and of equal ones the highest. A null: the
    signal rejects nothing. Strata without labels get no row."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = (
        stats.where(~base_failed())
        .join(best, "doc_id")
        .select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), (F.col("quality") == 1).alias("good"), *(_bin(v).alias(k) for k, v in _signals("__q").items()))
    )
    tall = held.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(k).alias("bin")) for k in SIGNALS))).alias("s")).select("stratum", "good", "s.*")
    counted = tall.groupBy("stratum", "signal", "bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    chain = Window.partitionBy("stratum", "signal")
    above = chain.orderBy(F.desc("bin"))
    level = (1 - confidence) / len(SIGNALS) / F.greatest(F.col("strata"), F.lit(1))
    tested = (
        counted.withColumn("n", F.sum("good").over(chain))
        .withColumn("lost", F.sum("good").over(above))
        .withColumn("caught", F.sum("bad").over(above))
        .crossJoin(F.broadcast(counted.agg(F.count_distinct("stratum").alias("strata"))))  # a single row
        .withColumn("p", binomial_tail(F.col("lost"), F.col("n"), risk / len(SIGNALS)))
        .withColumn("worst", F.max("p").over(above))
        .where((F.col("worst") <= level) & (F.col("caught") - F.lit(loss) * F.col("lost") > 0) & (F.col("bin") > 0))
    )
    chosen = tested.groupBy("stratum", "signal").agg(F.max_by(F.col("bin") - 1, F.struct(F.col("caught") - F.lit(loss) * F.col("lost"), "bin")).alias("cutoff"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("signal") == k, F.col("cutoff"))).alias(f"__cut_{k}") for k in SIGNALS))


def judged(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured (with __q) and base_failed, rule_failed, kept."""
    joined = measured.withColumn("__stratum", F.coalesce(F.col(stratum), F.lit(""))).join(chosen.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    over = F.lit(False)
    for k, v in _signals("__q").items():
        over = over | F.coalesce(_bin(v) > F.col(f"__cut_{k}"), F.lit(False))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("rule_failed", over)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("rule_failed"))
        .drop("__stratum", *(f"__cut_{k}" for k in SIGNALS))
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents. Null text has no words, so the base rules reject it; a
    null language is a stratum of its own; with no labels only the base rules reject."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats, _ = materialize(with_stats(docs.select("doc_id", "text", "lang")).drop("text"), "stats")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    chosen, _ = materialize(cutoffs(stats, labels), "cutoffs")
    return judged(stats, chosen).select(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words", "base_failed", "kept", "rule_failed"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the rules reject, in their own columns.

    Counts are taken once, into a table; rows are then matched to their verdicts by doc_id, language
    and a hash of the text, which is all that a verdict depends on."""
    marked = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("__th"))
    stats, _ = materialize(with_stats(marked).drop("text"), "stats")
    chosen, _ = materialize(cutoffs(stats, labels.select("doc_id", "quality")), "cutoffs")
    good = judged(stats, chosen).where("kept").select(F.col("doc_id").alias("__d"), F.col("lang").alias("__l"), F.col("__th").alias("__t"))
    good, _ = materialize(good.distinct(), "good")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("lang").eqNullSafe(F.col("__l")) & (F.col("__h") == F.col("__t"))
    return docs.withColumn("__h", F.xxhash64("text")).join(good, same, "left_semi").select(docs.columns)
