"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets fixed base counts; four ratios derived from them are the rules. A labelled holdout decides, for each
stratum and rule, the lowest cutoff whose false-rejection rate is bounded: with n good documents of the stratum and k of
them at or above the cutoff, P(Binomial(n, a) <= k) must not exceed d, where a is the rule's share of the tolerated
false-rejection rate and d the error probability divided by the number of tests (Bonferroni over rules, strata and
cutoffs). So with probability 1 - delta no stratum loses more than alpha of its good documents to the rules. A stratum
with too few labels gets no cutoff, and so keeps everything the base test keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, with_small

SYMBOLS = "#*$%&|<>"
RULES = ("upper_ratio", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: Cutoffs are multiples of 1/STEPS.
STEPS = 64


def base_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep + base counts, each over the whole text (null: empty). Other columns of docs are ignored.

    Windows of 8 words are compared by the 64-bit hash of their words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c) for c in keep], t.alias("_t")).select(
        *keep,
        "_t",
        F.regexp_extract_all(F.col("_t"), F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(WORD)).alias("_l"),
        F.translate(F.col("_t"), WHITE, "").alias("_s"),
    )
    empty = F.array().cast("array<bigint>")
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length("_s").cast("long").alias("word_chars"),
        (F.length("_s") - F.length(F.translate("_s", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_s") - F.length(F.regexp_replace("_s", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") > 8,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("_w") - 7, F.lit(1))),
                lambda i: F.xxhash64(F.slice("_w", i, 8)),
            ),
        ).otherwise(empty).alias("_h"),
    )
    df = df.withColumn(
        "_st",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.expr(
        """sort_array(transform(filter(_st, (x, i) ->
             (i > 0 and get(_st, i - 1).h = x.h) or coalesce(get(_st, i + 1).h = x.h, false)), x -> x.i))"""
    )
    df = df.withColumn("_p", F.when(F.col("_st").isNotNull(), twice))
    covered = F.expr(
        "aggregate(transform(_p, (p, i) -> least(8, coalesce(get(_p, i + 1) - p, 8))), 0L, (a, x) -> a + x)"
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_st", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _lgamma(z: Column) -> Column:
    """ln Gamma(z), z >= 1: Stirling's series eight places up."""
    y = z + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    low = F.log(z * (z + 1) * (z + 2) * (z + 3)) + F.log((z + 4) * (z + 5) * (z + 6) * (z + 7))
    return series - low


def binomial_cdf(n: Column, k: Column, a: float) -> Column:
    """P(Binomial(n, a) <= k) by summing downwards from k; 1 where k is not below the mean."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(
        _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(a)) + (n - k) * F.log(F.lit(1 - a))
    )
    steps = F.least(k, F.ceil(F.sqrt(n * (a * (1 - a))) * 12) + 200).cast("int")
    odds = (1 - a) / a
    folded = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct(
            (acc["w"] * (k - i + 1) * odds / (n - k + i)).alias("w"),
            (acc["s"] + acc["w"] * (k - i + 1) * odds / (n - k + i)).alias("s"),
        ),
    )
    return F.when(k >= n * a, F.lit(1.0)).otherwise(F.least(top * folded["s"], F.lit(1.0)))


def _scores(df: DataFrame) -> DataFrame:
    """Ratios as whole numbers of 1/STEPS, 0 to STEPS."""
    def bins(num: str, den: str) -> Column:
        return F.least(F.floor(F.col(num) * STEPS / F.greatest(F.col(den), F.lit(1))), F.lit(STEPS)).cast("int")

    pairs = {
        "upper_ratio": ("n_upper", "word_chars"),
        "symbol_ratio": ("n_symbols", "word_chars"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
    }
    return df.withColumns({r: bins(*p) for r, p in pairs.items()})


def thresholds(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02,
               delta: float = 0.05) -> DataFrame:
    """One row per stratum: the certified cutoff of each rule, null where none is.

    features: base_features(); labels: doc_id, quality (1: good). Documents that fail the base test, and rows of labels
    with nulls, take no part; repeated label rows of one document count once.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = _scores(features).where(~base_failed()).join(good, "doc_id", "left_semi")
    tall = held.select(
        F.col(stratum).alias("stratum"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES])).alias("x"),
    ).groupBy("stratum", "x.rule", "x.bin").agg(F.count("*").alias("n"))
    whole = tall.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("bin", "n")).alias("bins")
    )
    # at most STEPS + 1 bins stand in the list
    cut = whole.select(
        "stratum", "rule", "n", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("cut"), "bins"
    ).withColumn("k", F.expr("aggregate(filter(bins, x -> x.bin >= cut), 0L, (a, x) -> a + x.n)")).drop("bins")
    strata = whole.select(F.count_distinct(F.coalesce(F.col("stratum"), F.lit("\x00"))).alias("strata"))
    tests = F.greatest(F.lit(1), F.lit(int(strata.first()[0]))) * (len(RULES) * STEPS)
    passed = binomial_cdf(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta) / tests
    return cut.groupBy("stratum").agg(
        *[F.min(F.when((F.col("rule") == r) & passed, F.col("cut"))).alias(f"cut_{r}") for r in RULES]
    )


def judge(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """features with base_failed and kept. A document of a stratum without cutoffs is kept unless it fails the base test."""
    c = cutoffs.withColumnRenamed("stratum", "_stratum")
    df = with_small(_scores(features), c, F.col(stratum).eqNullSafe(F.col("_stratum")))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum")
