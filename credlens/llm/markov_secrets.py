"""Secret scan: fixed patterns, and random-looking strings found by two character Markov models.

The patterns give the base spans. The method scores every further run of token characters: one
first-order model of random strings, one of ordinary identifiers, and the sum over the run of the
log-likelihood ratios of its transitions (in thousandths, whole numbers, so that sums are exact).
A run is a secret if that sum reaches ``THRESHOLD`` for each character, it has
``DIFFERENT`` different characters or more, and it overlaps no base span.

Training: the random class has the secrets that the patterns label, in all documents, and for
each document of a sample a random string made from its id; the ordinary class has the words of
that sample, as far as they are too short to be scored and the patterns found nothing there. The
sample is bounded: documents whose hash is below ``SAMPLE / number of documents``. The models have
68 x 68 cells, whatever the input.

Everything is a DataFrame expression: positions come from the lengths of what lies between
matches, summed in blocks. Raw secrets are not written anywhere, only their positions are.

Defined results: null text is empty; a null id is passed on and counts as an empty string where
it is hashed; repeated rows are scanned one by one; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns, and the lengths from which their matches count.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS, ASSIGN_LENGTH = ("password", "passwd", "secret", "token", "apikey", "api_key"), 8
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of a run, and its least length.
ALPHABET, RUN_LENGTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % RUN_LENGTH
#: Documents of the training sample, least characters of an ordinary word.
SAMPLE, WORD_LENGTH = 4000, 8
#: Added to each character's count; transitions weigh in the characters' shares as so many more.
SMOOTHING, BACKOFF = 0.5, 34
#: Thousandths of a nat for each character from which a run is a secret: e times likelier each.
THRESHOLD = 1_000
#: Different characters that a run must have: a ruler of dashes or padding is not a secret.
DIFFERENT = 8
_SIDE = len(ALPHABET) + 1
_BLOCK = 256


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts, from the texts between matches; sums go block by block."""
    widths = F.zip_with(matches, gaps, lambda m, g: F.struct(
        F.coalesce(F.length(g), F.lit(0)).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
    n = F.size(matches)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(widths, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.array().cast("array<int>")

    def append(state: Column, width: Column) -> Column:
        return F.struct((state["at"] + width["gap"] + width["own"]).alias("at"),
                        F.array_append(state["found"], state["at"] + width["gap"]).alias("found"))

    def add(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), zero.alias("found")), append)
        return F.struct(inner["at"].alias("at"), F.array_append(state["found"], inner["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("found"))
    return F.slice(F.flatten(F.aggregate(blocks, start, add)["found"]), F.lit(1), n)


def _spans(text: Column, matches: Column, pattern: str, rank: int, keep: Column | None = None) -> Column:
    """(start, rank, stop) of the matches of a pattern; ``keep``: per match, whether it counts."""
    starts = _starts(F.split(text, pattern, -1), matches)
    spans = F.zip_with(starts, matches, lambda s, m: F.struct(
        s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("stop"), m.alias("value")))
    if keep is not None:
        spans = F.filter(F.zip_with(spans, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"])
        spans = F.transform(spans, lambda x: x["s"])
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,value:string>>")
    return F.when(F.size(matches) > 0, spans).otherwise(empty)


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, values, assign, access, hex): the patterns' spans and the secrets they label."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.array().cast("array<string>")
    lower = F.lower("text")
    named = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in ASSIGN_WORDS])
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    df = df.select("*", named.alias("named"), F.contains("text", F.lit("AKIA")).alias("keyed"))
    df = df.select("doc_id", "text",
                   F.when(F.col("named"), F.regexp_extract_all("text", F.lit(ASSIGN), 0)).otherwise(none).alias("m0"),
                   F.when(F.col("named"), F.regexp_extract_all("text", F.lit(ASSIGN), 2)).otherwise(none).alias("v0"),
                   F.when(F.col("keyed"), F.regexp_extract_all("text", F.lit(ACCESS), 0)).otherwise(none).alias("m1"),
                   F.regexp_extract_all("text", F.lit(HEX), 0).alias("m2"))
    long_enough = F.transform("v0", lambda v: F.length(v) >= ASSIGN_LENGTH)
    values = F.concat(F.filter("v0", lambda v: F.length(v) >= ASSIGN_LENGTH), F.col("m1"), F.col("m2"))
    return df.select("doc_id", "text", values.alias("values"),
                     _spans(F.col("text"), F.col("m0"), ASSIGN, 0, long_enough).alias("assign"),
                     _spans(F.col("text"), F.col("m1"), ACCESS, 1).alias("access"),
                     _spans(F.col("text"), F.col("m2"), HEX, 2).alias("hex"))


def _cells(token: Column) -> Column:
    """The transitions of a token as numbers: previous character * side + character, 0 before the first."""
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(token)),
                       lambda i: F.when(i > 1, place(i - 1)).otherwise(0) * _SIDE + place(i))


def train(base: DataFrame, documents: int, sample: int = SAMPLE) -> list[int]:
    """Weights of all transitions, in thousandths, from labelled samples."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    chosen = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") < F.lit(sample * (1 << 32) // max(documents, 1))
    made = F.base64(F.unhex(F.sha2(name, 256)))
    words = F.filter(F.split("text", r"[^A-Za-z0-9+/_=-]+"), lambda w: F.length(w).between(WORD_LENGTH, RUN_LENGTH - 1))
    rows = base.select(F.concat(F.col("values"), F.when(chosen, F.array(made)).otherwise(F.array().cast("array<string>"))).alias("random"),
                       F.when(chosen & (F.size("values") == 0), words).otherwise(F.array().cast("array<string>")).alias("plain"))
    counts = None
    for label in ("random", "plain"):
        part = (rows.select(F.explode(label).alias("token")).select(F.explode(_cells(F.col("token"))).alias("cell"))
                .groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label)))
        counts = part if counts is None else counts.unionByName(part)
    cells = base.sparkSession.range(_SIDE * _SIDE).withColumnRenamed("id", "cell")
    for label in ("random", "plain"):
        cells = cells.join(counts.filter(F.col("label") == label).select("cell", F.col("n").alias(label)), "cell", "left")
    cells = cells.fillna(0).withColumn("before", F.floor(F.col("cell") / _SIDE)).withColumn("after", F.col("cell") % _SIDE)
    rows_of = cells.groupBy("before").agg(F.sum("random").alias("random_row"), F.sum("plain").alias("plain_row"))
    whole = Window.partitionBy()  # one row for each character
    shares = cells.groupBy("after").agg(F.sum("random").alias("r"), F.sum("plain").alias("p")).select(
        "after", *[((F.col(c) + SMOOTHING) / (F.sum(c).over(whole) + SMOOTHING * _SIDE)).alias(f"{name}_share")
                   for c, name in (("r", "random"), ("p", "plain"))])
    chance = lambda n: F.log((F.col(n) + BACKOFF * F.col(f"{n}_share")) / (F.col(f"{n}_row") + BACKOFF))
    weights = cells.join(rows_of, "before").join(shares, "after").select(
        "cell", F.round(1000 * (chance("random") - chance("plain"))).cast("int").alias("w"))
    return [r["w"] for r in weights.orderBy("cell").collect()]  # one for each pair of characters


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
                 threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = find_base(docs, id_col, text_col)
    weights = train(base, docs.count(), sample)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    score = lambda token: F.aggregate(_cells(token), F.lit(0).cast("long"), lambda a, c: a + F.element_at(table, c + 1))
    df = base.select("doc_id", "text", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"),
                     F.regexp_extract_all("text", F.lit(RUN), 0).alias("runs"))
    df = df.select("doc_id", "assign", "access", "hex", "base", _spans(F.col("text"), F.col("runs"), RUN, 3).alias("runs"))
    added = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))
                     & (F.size(F.array_distinct(F.split(r["value"], ""))) >= DIFFERENT) & (score(r["value"]) >= threshold * F.length(r["value"])))
    narrow = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["stop"])))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(narrow(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                     F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", added)).alias("spans"))
