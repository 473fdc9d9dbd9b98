"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers.

Everything is Column expressions. Base spans come from three patterns; further spans (kind `markov`) are runs of
`RUN` characters whose log-likelihood ratio under the two bigram models, random strings against ordinary identifiers,
is at least `RATIO` in all and `PER_PAIR` for each pair. Of a run that isn't so as a whole, the segments are spans that
are so and at least `LEAST` long (a key behind a path or a name): a scan sums the pairs' ratios less `PER_PAIR`, starts
again where the sum isn't positive or `DROP` below its peak, and each peak ends a segment, which is then widened to the
next '/', '-' or '_'. Of such a span, what no base span covers is kept if it has `REST` characters. The models are counted with add-one smoothing from labelled
samples (token, secret): random strings drawn by hash; identifiers made of the words `NAMES`; and those of `SAMPLE_ROWS`
distinct texts of the table, the first by hash, alone and joined as code joins them (a bounded sample of labelled rows). Only pair
counts, at most 2 * 80 * 80, reach the driver. No pattern can match across a line break.

Places are code points, ends exclusive. Running sums are taken in chunks, so a text with very many matches costs no
square of their number.

Defined results: a null text is an empty one, with no spans; repeated rows and ties give equal results; an empty table
trains on drawn strings and made names; further columns are ignored by `scanned` and kept by `redacted`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import table

# The base patterns of the contract; `{24,}` and `{16,}` find what the open runs find after their length check.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+"
IDENTIFIER = r"[A-Za-z0-9+/_-]{3,}+"
RATIO, PER_PAIR = 12.0, 0.6
DROP, LEAST, REST = 6.0, 16, 6
SAMPLE_ROWS, DRAWN = 2000, 20_000
LOW, SPAN = 43, 80  # '+' to 'z'
CHUNK = 128
MARK = "[SECRET]"
# Words of which ordinary identifiers are made, for corpora that have few of their own.
NAMES = """account action active address array base block buffer build button cache call change check class client code column
config connection content count create current data date default delete device document element entry error event field file
filter format function get group handler header height host image index info input item key label length level line link list
load local lock manager map message method model module name network node number object option order page parent path point
port position process property query random read record request result root row save search select server service session set
size source start state status string system table target task temp test text thread time title total type update user value
version view width window word write""".split()

SpanType = "array<struct<start:int,kind:int,stop:int>>"


def let(x: Column, body) -> Column:
    """body(x) with x worked out once, however often and within whatever lambda the body refers to it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def running(values: Column) -> Column:
    """Inclusive running sums of an array of ints."""
    return let(values, running_sums)


def running_sums(a: Column) -> Column:
    def sums(x: Column, first: Column) -> Column:
        return F.slice(F.aggregate(x, F.array(first), lambda s, v: F.concat(s, F.array(F.get(s, F.size(s) - 1) + v))), F.lit(2), F.size(x))

    zero = F.lit(0)
    n = F.greatest(F.lit(1), F.ceil(F.size(a) / CHUNK).cast("int"))
    chunks = F.transform(F.sequence(zero, n - 1), lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK)))
    heads = F.concat(F.array(zero), sums(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, v: s + v)), zero))
    return F.when(F.size(a) <= CHUNK, sums(a, zero)).otherwise(F.flatten(F.zip_with(chunks, F.slice(heads, F.lit(1), n), sums)))


def found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the matches of a pattern without empty matches; keep: match, its second group -> boolean."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(hits, F.char_length)
    ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(size)), size, lambda g, m: g + m))
    spans = F.zip_with(ends, size, lambda e, m: F.struct((e - m).alias("start"), F.lit(kind).alias("kind"), e.alias("stop")))
    if keep is not None:
        spans = F.transform(F.filter(F.zip_with(spans, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SpanType)).cast(SpanType)


def base_spans(text: Column) -> list[Column]:
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= VALUE)
    return [found(text, ASSIGN, 0, long_value), found(text, ACCESS, 1), found(text, HEX, 2)]


def code(token: Column, i: Column) -> Column:
    return F.ascii(F.substring(token, i, F.lit(1))) - LOW


def pair_ratios(token: Column, ratios: Column) -> Column:
    """The log-likelihood ratio of a token of the run alphabet."""
    return F.aggregate(F.sequence(F.lit(2), F.char_length(token)), F.lit(0.0), lambda s, i: s + F.get(ratios, code(token, i - 1) * SPAN + code(token, i)))


ScanType = "struct<start:int,sum:double,raw:double,peak:double,peak_raw:double,first:int,last:int,out:array<struct<a:int,b:int>>>"


def segments(token: Column, ratios: Column) -> Column:
    """(a, b) of the segments of a run that look random: the place before the first character, and the last one's place."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    zero, nought = F.lit(0.0), F.lit(0)
    first = F.struct(nought.alias("start"), *[zero.alias(c) for c in ("sum", "raw", "peak", "peak_raw")], nought.alias("first"), nought.alias("last"), none.alias("out")).cast(ScanType)

    def closed(s: Column) -> Column:
        return F.when(s["peak_raw"] >= RATIO, F.concat(s["out"], F.array(F.struct((s["first"] - 1).alias("a"), s["last"].alias("b"))))).otherwise(s["out"])

    def step(s: Column, i: Column) -> Column:
        ratio = F.get(ratios, code(token, i - 1) * SPAN + code(token, i))
        return let(F.struct(s.alias("s"), i.alias("i"), ratio.alias("r")), moved)

    def moved(x: Column) -> Column:
        s, on = x["s"], x["s"]["sum"] > 0
        now = F.struct(F.when(on, s["start"]).otherwise(x["i"] - 1).alias("start"), (F.when(on, s["sum"]).otherwise(zero) + x["r"] - PER_PAIR).alias("sum"), (F.when(on, s["raw"]).otherwise(zero) + x["r"]).alias("raw"))
        return let(F.struct(s.alias("s"), x["i"].alias("i"), now.alias("n")), peaked)

    def peaked(x: Column) -> Column:
        s, n = x["s"], x["n"]
        up = n["sum"] > s["peak"]
        ends = (s["peak"] > 0) & ((n["sum"] <= 0) | (n["sum"] <= s["peak"] - DROP))
        kept = lambda new, old: F.when(up, new).otherwise(old)
        on = F.struct(n["start"], n["sum"], n["raw"], kept(n["sum"], s["peak"]), kept(n["raw"], s["peak_raw"]), kept(n["start"], s["first"]), kept(x["i"], s["last"]), s["out"]).cast(ScanType)
        again = F.struct(nought, zero, zero, zero, zero, nought, nought, closed(s)).cast(ScanType)
        return F.when(ends, again).otherwise(on)

    def widened(x: Column) -> Column:
        bar = lambda at: F.substring(token, at, F.lit(1)).rlike("[/_-]")
        inner = F.struct((x["a"] + bar(x["a"] + 1).cast("int")).alias("a"), (x["b"] - bar(x["b"]).cast("int")).alias("b"))
        left = lambda y: F.char_length(F.regexp_extract(F.substring(token, F.lit(1), y["a"]), "[^/_-]*$", 0))
        right = lambda y: F.char_length(F.regexp_extract(F.substring(token, y["b"] + 1, F.char_length(token)), "^[^/_-]*", 0))
        return let(inner, lambda y: F.struct((y["a"] - left(y)).alias("a"), (y["b"] + right(y)).alias("b")))

    wide = F.array_distinct(F.transform(F.aggregate(F.sequence(F.lit(2), F.char_length(token)), first, step, closed), widened))
    return F.filter(wide, lambda x: (x["b"] - x["a"] >= LEAST) & F.substring(token, x["a"] + 1, x["b"] - x["a"]).rlike("[A-Za-z]"))


def markov_spans(text: Column, ratios: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))

    def random(t: Column) -> Column:
        n = F.char_length(t)
        whole = let(pair_ratios(t, ratios), lambda ratio: (ratio >= RATIO) & (ratio >= PER_PAIR * (n - 1)))
        own = F.when(whole, F.array(F.struct(F.lit(0).alias("a"), n.alias("b")))).otherwise(segments(t, ratios))
        return F.when(t.rlike("[A-Za-z]"), own).otherwise(F.array().cast("array<struct<a:int,b:int>>"))

    placed = F.zip_with(found(text, RUN, 3), F.transform(tokens, random), lambda s, own: F.transform(own, lambda x: F.struct((s["start"] + x["a"]).alias("start"), s["kind"].alias("kind"), (s["start"] + x["b"]).alias("stop"))))
    return F.when(text.rlike(RUN), F.flatten(placed)).otherwise(F.array().cast(SpanType)).cast(SpanType)


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS, drawn: int = DRAWN) -> DataFrame:
    """token, secret: strings drawn by hash in four alphabets (true), identifiers of a sample of rows (false)."""
    spark = docs.sparkSession
    bits = F.sha2(F.concat(F.lit("drawn"), F.col("id").cast("string")), 256)
    packed = F.substring(F.regexp_replace(F.base64(F.unhex(bits)), "=", ""), 1, 40)
    forms = F.array(packed, F.translate(packed, "+/", "-_"), F.regexp_replace(packed, "[+/]", ""), F.substring(bits, 1, 40))
    rand = spark.range(drawn).select(F.explode(forms).alias("token"), F.lit(True).alias("secret"))
    hashed = docs.select(F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    last = hashed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    own = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text"))
    plain = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, ACCESS, HEX), F.col("text"))
    words = own.select(F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0)).alias("w"))
    joined = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), F.pmod(F.xxhash64(a, b), F.lit(4)).cast("int") + 1), F.initcap(b))))
    names = words.select(F.explode(F.concat("w", joined)).alias("token"), F.lit(False).alias("secret")).where("token IS NOT NULL")
    words_ = F.array(*map(F.lit, NAMES))
    made = F.array(F.concat("a", F.initcap("b")), F.concat("a", F.lit("_"), "b"), F.concat("a", F.lit("-"), "b", F.lit("/"), "a"))
    common = spark.range(1).select(F.explode(words_).alias("a")).select("a", F.explode(words_).alias("b")).select(F.explode(made).alias("token"), F.lit(False).alias("secret"))
    return rand.unionByName(names).unionByName(common)


def trained(labelled: DataFrame) -> Column:
    """The log-likelihood ratios of all pairs, as a constant array."""
    n = F.char_length("token")
    pairs = labelled.where(n > 1).select("secret", "token", F.explode(F.sequence(F.lit(2), n)).alias("i"))
    counts = pairs.groupBy("secret", code(F.col("token"), F.col("i") - 1).alias("a"), code(F.col("token"), F.col("i")).alias("b")).count().collect()
    table_: dict[bool, list[list[float]]] = {s: [[1.0] * SPAN for _ in range(SPAN)] for s in (True, False)}
    for r in counts:
        if 0 <= r["a"] < SPAN and 0 <= r["b"] < SPAN:
            table_[r["secret"]][r["a"]][r["b"]] += r["count"]
    logs = {s: [[math.log(x / sum(row)) for x in row] for row in rows] for s, rows in table_.items()}
    ratios = [p - q for a, b in zip(logs[True], logs[False], strict=True) for p, q in zip(a, b, strict=True)]
    return F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")


def uncovered(span: Column, base: Column) -> Column:
    """The parts of a span that no base span (sorted by start) covers, of REST characters or more."""
    kind = f"struct<at:int,out:{SpanType}>"
    gap = lambda s, stop: F.when(stop - s["at"] >= REST, F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), span["kind"].alias("kind"), stop.alias("stop"))))).otherwise(s["out"])
    first = F.struct(span["start"].alias("at"), F.array().cast(SpanType).alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        met = (x["start"] < span["stop"]) & (x["stop"] > s["at"])
        return F.when(met, F.struct(F.greatest(s["at"], x["stop"]).alias("at"), gap(s, x["start"]).alias("out")).cast(kind)).otherwise(s)

    return F.aggregate(base, first, step, lambda s: gap(s, span["stop"]))


def all_spans(text: Column, ratios: Column) -> tuple[Column, Column]:
    """(base spans by start and kind, all spans likewise): of the further ones what base spans leave."""
    base = F.array_sort(F.concat(*base_spans(text)))
    rest = lambda b: F.flatten(F.transform(markov_spans(text, ratios), lambda m: uncovered(m, b)))
    return base, let(base, lambda b: F.array_sort(F.concat(b, rest(b))))


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scanned(docs: DataFrame, ratios: Column) -> DataFrame:
    """doc_id, text, base and spans (start, kind, stop)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, spans = all_spans(text, ratios)
    return docs.select("doc_id", "text", F.struct(base.alias("base"), spans.alias("spans")).alias("x")).select("doc_id", "text", "x.base", "x.spans")


def redacted_line(line: Column, ratios: Column) -> Column:
    """A line with every span replaced by MARK; spans that meet count as one."""
    _, spans = all_spans(line, ratios)
    kind = "struct<at:int,out:array<string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(line, s["at"] + 1, x["start"] - s["at"])
        apart = (x["start"] >= s["at"]) & ((s["at"] == 0) | (x["start"] > s["at"])) | (F.size(s["out"]) == 0)
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(apart, F.concat(s["out"], F.array(gap, F.lit(MARK)))).otherwise(s["out"]).alias("out")).cast(kind)

    rebuilt = F.aggregate(spans, first, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(line, s["at"] + 1, F.char_length(line))))
    anything = reduce(lambda a, b: a | b, [line.rlike(p) for p in (ASSIGN, ACCESS, HEX, RUN)])
    return F.when(anything, rebuilt).otherwise(line)


def redacted(docs: DataFrame, ratios: Column) -> DataFrame:
    """docs with every secret in text replaced by MARK; every column stays."""
    text = F.array_join(F.transform(F.split("text", "\n", -1), lambda line: redacted_line(line, ratios)), "\n")
    return docs.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def counted(spans: Column, kind: int) -> Column:
    """The number of spans of a kind. The lambda has one parameter: to a second one, even with a default, Spark gives the place."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scanned(docs, trained(samples(docs)))
    count = [counted(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *count, F.sha2(rendered(F.col("base")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
