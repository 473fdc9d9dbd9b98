"""Quality rules: base limits, and robust multivariate outliers for each language and source.

Everything is Column expressions and aggregates. Each text gives a vector of transformed statistics (`FEATURES`). For
each (lang, source) the minimum-covariance-determinant estimate is sought from three deterministic `STARTS`, all of them
from medians and absolute deviations of the group: distances by these alone, by the covariance of the standardised
vectors' hyperbolic tangents, and by that of their directions. From each start the `HALF` nearest rows give a mean and
covariance, these give new distances, and so on (`STEPS` concentration steps); of the three, the one with the least
determinant is the group's estimate.

Groups are of any size, and all are treated alike: an estimate is that of n rows and of `PRIOR` rows of its language's
estimate, this in turn of its rows and `PRIOR` of the whole table's; both are pooled from the groups' estimates. So a
group of a few rows leans on its language, one of thousands on itself. As the nearest rows alone make a covariance too
small, `REWEIGHTS` steps follow that take all rows within `NEAR`. A variance below its floor (`FLOOR`) is raised to it, so
statistics that hardly vary can't make the matrix singular, nor one symbol or repeated line an outlier; distances are
scaled so that a group's median is that of a chi-square variable, and a document is rejected if its squared Mahalanobis
distance is beyond `CUTOFF`.

Sums of a group are partial aggregates, so a group with a third of all rows is no burden; estimates come back to rows by a
join on (lang, source), broadcast up to `BROADCAST` groups of a few hundred bytes, else salted.

Defined results: a null or empty text has no words and fails the base; null lang and source are groups like others, apart
from empty ones; equal texts of one group get equal verdicts; an empty table gives an empty table; further columns are
ignored, and doc_id may be of any type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import table, written

MIN_WORDS, MAX_REPEAT = 50, 50
# The blanks, symbols and lines of the contract.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
FLOOR = (0.3, 0.25, 0.08, 0.1, 0.1)  # least standard deviations
STARTS, HALF, STEPS, PRIOR = 3, 0.75, 3, 50.0
BROADCAST, SALTS = 50_000, 16
REWEIGHTS, NEAR = 2, 12.833  # of chi-square with 5 degrees: the value passed once in 40
MEDIAN, CUTOFF = 4.351, 20.515  # of chi-square with 5 degrees: its median, and the value passed once in 1,000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_repeats(df: DataFrame) -> DataFrame:
    """df (grams: a hash for each 3-word window) with n_repeat_words, the words in windows found twice or more. Each step
    is a column of its own: within a lambda an expression would be worked out again for each element."""
    long_, ints_ = F.array().cast("array<struct<h:bigint,i:int>>"), F.array().cast("array<int>")
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    a = df.withColumn("order", F.when(some, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(long_))
    get = lambda j: F.get("order", j)
    twice = F.transform(F.sequence(F.lit(0), F.size("order") - 1), lambda j: F.when((get(j)["h"] == get(j - 1)["h"]) | (get(j)["h"] == get(j + 1)["h"]), get(j)["i"]))
    b = a.withColumn("starts", F.when(F.size("order") > 0, F.sort_array(F.filter(twice, lambda x: x.isNotNull()))).otherwise(ints_))
    last = F.size("starts") - 1
    covered = F.aggregate(F.zip_with(F.slice("starts", F.lit(1), last), F.slice("starts", F.lit(2), last), lambda x, y: F.least(F.lit(3), y - x)), F.lit(3), lambda s, x: s + x)
    return b.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered).otherwise(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five statistics of whole texts."""
    src = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK, -1))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # Stages: what is used more than once is a column before it is used.
    a = src.select("doc_id", "lang", "source", words.alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"))
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    b = with_repeats(a.withColumn("grams", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>"))))
    return b.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", F.size("lines").cast("long").alias("n_lines"),
    )


def features() -> list[Column]:
    n, lines = F.greatest(F.lit(1), F.col("n_words")), F.greatest(F.lit(1), F.col("n_lines"))
    root = [F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n)]
    return [x.cast("double").alias(f) for x, f in zip((F.log(n), F.log(1 + F.col("word_chars") / n) * 2, *root), FEATURES, strict=True)]


D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]  # a lower triangle, packed by rows
GROUP = ["glang", "gsource"]


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def ints(xs: list[int]) -> Column:
    return F.array(*map(F.lit, xs))


def at(i: Column, j: Column) -> Column:
    """The place of (i, j) in a packed triangle."""
    return (i * (i + 1) / 2).cast("int") + j


def filled(step) -> Column:
    """A packed triangle, made entry by entry: step(triangle so far, i, j) gives the next one."""
    first, second = ints([i for i, _ in PAIRS]), ints([j for _, j in PAIRS])
    return F.aggregate(ints(list(range(len(PAIRS)))), F.array().cast("array<double>"), lambda t, p: F.concat(t, F.array(step(t, F.get(first, p), F.get(second, p)))))


def summed(low: Column, high: Column, term) -> Column:
    """The sum of term(k) for low <= k < high."""
    return F.aggregate(F.slice(ints(list(range(D))), low + 1, high - low), F.lit(0.0), lambda s, k: s + term(k))


def whitener(cov: Column) -> Column:
    """The inverse of the Cholesky factor of a covariance; all packed triangles."""

    def factor(t: Column, i: Column, j: Column) -> Column:
        rest = F.get(cov, at(i, j)) - summed(F.lit(0), j, lambda k: F.get(t, at(i, k)) * F.get(t, at(j, k)))
        return F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-9)))).otherwise(rest / F.get(t, at(j, j)))

    root = F.array(filled(factor))  # an array of one, so that what follows refers to it without working it out again

    def inverse(low: Column) -> Column:
        def step(t: Column, i: Column, j: Column) -> Column:
            own = F.get(low, at(i, i))
            return F.when(i == j, 1 / own).otherwise(-summed(j, i, lambda k: F.get(low, at(i, k)) * F.get(t, at(k, j))) / own)

        return filled(step)

    return F.element_at(F.transform(root, inverse), 1)


def distance() -> Column:
    """The squared distance of a row with columns m (means) and w (whitener)."""
    gap = [F.col(f) - F.get("m", F.lit(i)) for i, f in enumerate(FEATURES)]
    rows = [total([F.get("w", F.lit(i * (i + 1) // 2 + j)) * gap[j] for j in range(i + 1)]) for i in range(D)]
    return total([r * r for r in rows])


def quantile(c: Column, p: float) -> Column:
    return F.percentile_approx(c, F.lit(p), F.lit(1000))


def joined(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows with what their group has; groups is a written table with a row for each group."""
    if groups.count() <= BROADCAST:
        return rows.join(F.broadcast(groups), on)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def sums_of(xs: list[Column]) -> list[Column]:
    """Sums of the entries of a vector, and of their products."""
    return [F.array(*[F.sum(x) for x in xs]).alias("s"), F.array(*[F.sum(xs[i] * xs[j]) for i, j in PAIRS]).alias("p")]


def covariance(n: Column, s: str, p: str, floors: list[float]) -> Column:
    """From sums; a variance below the square of its floor is raised to it."""
    own = {(i, j): F.get(p, F.lit(k)) / n - F.get(s, F.lit(i)) * F.get(s, F.lit(j)) / (n * n) for k, (i, j) in enumerate(PAIRS)}
    return F.array(*[F.greatest(own[i, j], F.lit(floors[i] ** 2)) if i == j else own[i, j] for i, j in PAIRS])


def vector(c: str) -> list[Column]:
    return [F.get(c, F.lit(i)) for i in range(D)]


def mean_of(n: Column) -> Column:
    return F.array(*[x / n for x in vector("s")])


def started(rows: DataFrame) -> DataFrame:
    """Groups with start, m and w: whiteners of the three starts, all about the medians."""
    mid = written(rows.groupBy(*GROUP).agg(F.array(*[quantile(F.col(f), 0.5) for f in FEATURES]).alias("m")), "medians")
    gaps = [F.abs(F.col(f) - x) for f, x in zip(FEATURES, vector("m"), strict=True)]
    spread = joined(rows, mid, GROUP).groupBy(*GROUP).agg(F.first("m").alias("m"), F.array(*[F.greatest(quantile(g, 0.5) * 1.4826, F.lit(FLOOR[i])) for i, g in enumerate(gaps)]).alias("scale"))
    spread = written(spread, "spreads")
    z = joined(rows, spread, GROUP).select(*GROUP, "m", "scale", F.array(*[(F.col(f) - x) / y for f, x, y in zip(FEATURES, vector("m"), vector("scale"), strict=True)]).alias("z"))
    flat = z.withColumn("t", F.transform("z", F.tanh)).withColumn("length", F.greatest(F.lit(1e-9), F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x))))
    kinds = [vector("t"), [x / F.col("length") for x in vector("z")]]
    sums = [F.struct(*sums_of(xs)).alias(f"x{k}") for k, xs in enumerate(kinds)]
    met = flat.groupBy(*GROUP).agg(F.count("*").cast("double").alias("n"), F.first("m").alias("m"), F.first("scale").alias("scale"), *sums)
    unit = F.array(*[F.lit(1.0 if i == j else 0.0) for i, j in PAIRS])
    starts = F.array(*[F.struct(F.lit(k).alias("start"), c.alias("c")) for k, c in enumerate((unit, *(covariance(F.col("n"), f"x{k}.s", f"x{k}.p", [0.03] * D) for k in range(2))))])
    own = written(met.select(*GROUP, "m", "scale", F.explode(starts).alias("x")).select(*GROUP, "m", "scale", "x.start", "x.c"), "starts")
    white = own.withColumn("v", whitener(F.col("c")))
    return white.select(*GROUP, "start", "m", F.array(*[F.get("v", F.lit(k)) / F.get("scale", F.lit(j)) for k, (i, j) in enumerate(PAIRS)]).alias("w"))


def concentrated(rows: DataFrame) -> DataFrame:
    """For each group n (rows), m and c: of the starts' estimates the one with the least determinant."""
    est = started(rows)
    for _ in range(STEPS + 1):
        est = written(est, "estimates")
        near = joined(rows, est, GROUP).select(*GROUP, "start", *FEATURES, distance().alias("d"))
        cut = written(near.groupBy(*GROUP, "start").agg(quantile(F.col("d"), HALF).alias("cut"), F.count("*").cast("double").alias("total")), "cuts")
        sums = joined(near, cut, [*GROUP, "start"]).where("d <= cut").groupBy(*GROUP, "start").agg(F.count("*").cast("double").alias("n"), F.first("total").alias("total"), *sums_of([F.col(f) for f in FEATURES]))
        moments = written(sums.select(*GROUP, "start", "total", mean_of(F.col("n")).alias("m"), covariance(F.col("n"), "s", "p", list(FLOOR)).alias("c")), "moments")
        est = moments.select(*GROUP, "start", "m", whitener(F.col("c")).alias("w"), "c", "total")
    size = -total([F.log(F.get("w", F.lit(i * (i + 3) // 2))) for i in range(D)])  # half the logarithm of the determinant
    best = written(est, "estimates").groupBy(*GROUP).agg(F.min(F.struct(size.alias("size"), "start", "total", "m", "c")).alias("x"))
    return best.select(*GROUP, F.col("x.total").alias("n"), "x.m", "x.c")


def raw(m: str, c: str) -> list[Column]:
    """Second moments from a mean and covariance."""
    return [F.get(c, F.lit(k)) + F.get(m, F.lit(i)) * F.get(m, F.lit(j)) for k, (i, j) in enumerate(PAIRS)]


def pooled(groups: DataFrame, by: list[str]) -> DataFrame:
    """The estimates (n, m, c) of groups as one for each `by`."""
    n = F.col("n")
    sums = groups.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[F.sum(n * x) for x in vector("m")]).alias("s"), F.array(*[F.sum(n * x) for x in raw("m", "c")]).alias("p"))
    return sums.select(*by, "n", mean_of(F.col("n")).alias("m"), covariance(F.col("n"), "s", "p", list(FLOOR)).alias("c"))


def leaning(n: Column) -> list[Column]:
    """m and c of n rows (m, c) and of PRIOR rows of the level above (pm, pc)."""
    whole = n + PRIOR
    m = [(n * x + PRIOR * y) / whole for x, y in zip(vector("m"), vector("pm"), strict=True)]
    p = [(n * x + PRIOR * y) / whole for x, y in zip(raw("m", "c"), raw("pm", "pc"), strict=True)]
    c = [F.greatest(p[k] - m[i] * m[j], F.lit(FLOOR[i] ** 2)) if i == j else p[k] - m[i] * m[j] for k, (i, j) in enumerate(PAIRS)]
    return [F.array(*m).alias("m"), F.array(*c).alias("c")]


def estimated(rows: DataFrame) -> DataFrame:
    """m, w and factor for each group of rows (glang, gsource, features)."""
    groups = written(concentrated(rows), "groups")
    langs = pooled(groups, ["glang"])
    every = pooled(langs.select("n", "m", "c"), []).select(F.col("m").alias("pm"), F.col("c").alias("pc")).limit(1)  # one row
    above = written(langs.join(F.broadcast(every)).select("glang", *leaning(F.col("n"))).select("glang", F.col("m").alias("pm"), F.col("c").alias("pc")), "languages")
    base = written(groups.join(above, "glang"), "bases")
    est = base.select(*GROUP, "n", *leaning(F.col("n")))
    for _ in range(REWEIGHTS):
        est = written(est.select(*GROUP, "n", "m", whitener(F.col("c")).alias("w")), "estimates")
        near = joined(rows, est, GROUP).select(*GROUP, "n", *FEATURES, distance().alias("d"))
        cut = written(near.groupBy(*GROUP).agg((scaled(F.first("n"), F.col("d")) * NEAR).alias("cut")), "cuts")
        sums = joined(near.drop("n"), cut, GROUP).where("d <= cut").groupBy(*GROUP).agg(F.count("*").cast("double").alias("near"), *sums_of([F.col(f) for f in FEATURES]))
        own = sums.select(*GROUP, "near", mean_of(F.col("near")).alias("m"), covariance(F.col("near"), "s", "p", list(FLOOR)).alias("c"))
        both = base.select(*GROUP, "n", "pm", "pc").join(own, GROUP, "left").select(*GROUP, "n", "pm", "pc", F.coalesce("near", F.lit(0.0)).alias("near"), F.coalesce("m", "pm").alias("m"), F.coalesce("c", "pc").alias("c"))
        est = written(both.select(*GROUP, "n", *leaning(F.col("near"))), "moments")
    est = written(est.select(*GROUP, "n", "m", whitener(F.col("c")).alias("w")), "estimates")
    factor = joined(rows, est, GROUP).groupBy(*GROUP).agg(scaled(F.first("n"), distance()).alias("factor"))
    return written(est.join(factor, GROUP).select(*GROUP, "m", "w", "factor"), "estimates")


def scaled(n: Column, d: Column) -> Column:
    """The factor, 1 or more, by which a group's distances are too large; of PRIOR further rows it is 1."""
    return F.greatest(F.lit(1.0), (n * quantile(d, 0.5) / MEDIAN + PRIOR) / (n + PRIOR))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance (squared, scaled)."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = written(statistics(docs).select("doc_id", name("lang").alias("glang"), name("source").alias("gsource"), *STATS, *features()), "statistics")
    far = joined(rows, estimated(rows.select(*GROUP, *FEATURES)), GROUP).withColumn("distance", distance() / F.col("factor"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return far.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & (F.col("distance") <= CUTOFF)).alias("kept"), "distance")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
