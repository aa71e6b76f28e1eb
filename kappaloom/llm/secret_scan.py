"""Secrets in texts: fixed patterns and a randomness test battery; built-in functions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from kappaloom.session import materialize

#: Kinds in the order of spans with one start; the last is what the battery adds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
#: 20 and 24 characters at least; runs are maximal, so a minimum in the pattern drops the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole run of at least 20 encoding characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"

LOWER, UPPER, DIGITS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_"
#: Encodings by the smallest alphabet that holds the run: (pattern, alphabet).
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("", UPPER + LOWER + DIGITS + SIGNS),
)
#: Ordinary text as a chain of character kinds (lower case, upper case, digit, sign): how often each
#: begins a run and follows each other, in percent ...
BEGINS = (50, 30, 15, 5)
FOLLOWS = ((93, 1.5, 1.5, 4), (55, 38, 3, 4), (8, 4, 68, 20), (68, 12, 17, 3))
#: ... and the letters a to z among letters, in per mille of English text.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 0.95, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.74)
#: Costs are whole numbers of this share of a bit, so that sums are exact.
PER_BIT = 64


def _cost(chance: float) -> int:
    return round(-log2(chance) * PER_BIT)


#: Symbols by kind; what each costs within its kind, and each kind at the beginning and after each other.
SYMBOLS = LOWER + UPPER + DIGITS + SIGNS
KIND_OF = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
WITHIN = [_cost(p / sum(LETTERS)) for p in LETTERS] * 2 + [_cost(0.1)] * 10 + [_cost(0.25)] * 4
FIRST = [_cost(p / 100) for p in BEGINS]
NEXT = [_cost(p / 100) for row in FOLLOWS for p in row]
#: Cost of a symbol of an even draw, by alphabet.
EVEN = [_cost(1 / len(alphabet)) for _, alphabet in ENCODINGS]
#: A run whose randomness is rejected at this level is no secret.
RANDOM_LEVEL = 0.001
#: Share of ordinary text that may be among the runs added.
FALSE_DISCOVERIES = 0.01
#: P values are counted in bins of sixteenths of a power of two.
BINS, PER_POWER = 4096, 16


def _hits(text: Column, pattern: str, kind: int) -> Column:
    """(kind, gap, n, token) of each match: characters before it since the last one, and its own."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))
    return F.transform(
        F.filter(pieces, lambda x: x["token"].isNotNull()),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).cast("long").alias("gap"),
                           F.length(x["token"]).cast("long").alias("n"), x["token"].alias("token")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, within 0.0002."""
    x = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(F.lit(1.5976) * x + F.lit(0.07056) * x * x * x))


def battery(runs: DataFrame) -> DataFrame:
    """``runs`` (token, n, ...) with p_random and p_text.

    The encoding is the smallest alphabet that holds the run. p_random is the combined level
    (Bonferroni) at which three tests reject an even draw from it: chi-squared of the symbol
    counts, runs above and below the middle of the alphabet, and circular serial correlation.
    p_text compares the run's chance as ordinary text, by the frequency of its letters and the changes
    between lower case, upper case, digits and signs, with that of an even draw. Text is t times less
    likely than the draw with a chance of 1 / t at most, whatever the length: the ratio itself is a level.
    """
    alphabet, even = F.lit(""), F.lit(0)
    for (pattern, letters), cost in reversed(list(zip(ENCODINGS, EVEN))):
        fits = F.col("token").rlike(pattern)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        even = F.when(fits, F.lit(cost)).otherwise(even)

    def listed(numbers) -> str:
        return f"array({', '.join(map(str, numbers))})"

    total = "0L, (s, x) -> s + x"
    steps = (
        ("alphabet", alphabet), ("even", even),
        ("a", F.length("alphabet").cast("double")),
        ("chars", F.split("token", "")),
        ("v", F.transform("chars", lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("long"))),
        ("high", F.expr("transform(v, x -> if(2 * x >= a, 1L, 0L))")),
        ("squares", F.expr(f"aggregate(transform(array_distinct(v), d -> cast(power(size(filter(v, x -> x = d)), 2) as long)), {total})")),
        ("s1", F.expr(f"aggregate(v, {total})")),
        ("s2", F.expr(f"aggregate(transform(v, x -> x * x), {total})")),
        ("lag", F.expr(f"aggregate(zip_with(v, concat(slice(v, 2, size(v) - 1), slice(v, 1, 1)), (x, y) -> x * y), {total})")),
        ("n1", F.expr(f"aggregate(high, {total})")),
        ("changes", F.expr(f"aggregate(zip_with(slice(high, 1, size(v) - 1), slice(high, 2, size(v) - 1), (x, y) -> abs(x - y)), {total})")),
        ("z_chi", F.expr("(a / n * squares - n - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n)")),
        ("mu", F.expr("2.0D * n1 * (n - n1) / n + 1")),
        ("spread", F.expr("(mu - 1) * (mu - 2) / (n - 1)")),
        ("z_runs", F.expr("if(spread > 0, abs(changes + 1 - mu) / sqrt(spread), sqrt(n))")),
        ("den", F.expr("n * s2 - s1 * s1")),
        ("z_serial", F.expr(
            "if(den > 0, abs((n * lag - s1 * s1) / den + 1.0D / (n - 1)) * (n - 1) * sqrt(n - 2) / n, sqrt(n))")),
        ("p_random", F.least(F.lit(1.0), 3 * F.least(
            _tail(F.col("z_chi")), 2 * _tail(F.col("z_runs")), 2 * _tail(F.col("z_serial"))))),
        ("s", F.transform("chars", lambda c: F.instr(F.lit(SYMBOLS), c))),
        ("k", F.expr(f"transform(s, x -> element_at({listed(KIND_OF)}, x))")),
        ("cost", F.expr(
            f"element_at({listed(FIRST)}, k[0] + 1) + aggregate(transform(s, x -> cast(element_at({listed(WITHIN)}, x) as long)), {total})"
            f" + aggregate(zip_with(slice(k, 1, size(k) - 1), slice(k, 2, size(k) - 1),"
            f" (x, y) -> cast(element_at({listed(NEXT)}, 4 * x + y + 1) as long)), {total})")),
        ("p_text", F.expr(f"pow(2.0D, -greatest(cost - n * even, 0L) / {PER_BIT}.0D)")),
    )
    out = runs
    for name, column in steps:
        out = out.withColumn(name, column)
    return out.select(*runs.columns, "p_random", "p_text")


def _spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, token, n) of every kept match of ``rows`` (row, hits)."""
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    every = rows.select("row", F.posexplode("hits").alias("pos", "hit")).select(
        "row", "pos", "hit.*").withColumn("end", F.sum(F.col("gap") + F.col("n")).over(order))
    secret = F.length(F.regexp_extract("token", ASSIGN, 2)) >= ASSIGN_LEAST
    return every.withColumn("start", F.col("end") - F.col("n")).where(
        (F.col("kind") != 0) | secret).select("row", "kind", "start", "end", "token", "n")


def _alone(spans: DataFrame) -> DataFrame:
    """The candidate runs that no base span touches, with a letter in them."""
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return spans.withColumn("before", before).withColumn("after", after).where(
        "kind = 3 and coalesce(before <= start, true) and coalesce(after >= end, true)"
    ).where(F.col("token").rlike("[A-Za-z]")).drop("before", "after")


def _discovered(runs: DataFrame) -> DataFrame:
    """The runs of which ordinary text makes up at most ``FALSE_DISCOVERIES``.

    Benjamini and Hochberg's step-up rule over the distinct runs of all documents, with weights
    in proportion to length: a long run needs less. P values are binned upwards, so the rule
    reads a table of at most ``BINS`` rows, whatever the number of runs.
    """
    distinct = runs.select("token", "n", "p_text").distinct()
    m, length = distinct.agg(F.count("*"), F.sum("n")).first()
    if not m:
        return runs
    weighted = F.col("p_text") * F.lit(float(length)) / (F.col("n") * F.lit(float(m)))
    place = F.when(weighted > 0, F.floor(-F.log2(weighted) * PER_POWER)).otherwise(F.lit(BINS - 1))
    bin_of = F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int")
    sizes = {r["bin"]: r["count"] for r in distinct.groupBy(bin_of.alias("bin")).count().collect()}
    found, limit = 0, BINS
    for b in range(BINS - 1, -1, -1):
        found += sizes.get(b, 0)
        if m * 2.0 ** (-b / PER_POWER) <= FALSE_DISCOVERIES * found:
            limit = b
    return runs.where(bin_of >= limit)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id, sign) of the input, spans (row, kind, start, end).

    Places are code points, the end exclusive; kind is the position in ``KINDS``. ``sign`` is a
    hash of the text. Base kinds match from the left without overlap, each kind by itself; runs
    are added where no base span touches them, the battery does not reject an even draw, and
    ordinary text is ruled out under false-discovery control. Matches are cut out in the row;
    their places are sums over a shuffle of the matches alone, so that texts are never moved and
    a text with very many matches takes no more than linear time.

    A null text is empty and holds nothing; repeated rows are rows of their own; an empty table
    gives empty ones; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("sign"),
        F.concat(*[_hits(text, p, k) for k, p in enumerate(patterns)]).alias("hits")), "matches")
    spans = materialize(_spans(rows), "spans")
    runs = materialize(battery(_alone(spans)), "runs")
    random = _discovered(runs).where(F.col("p_random") >= RANDOM_LEVEL)
    place = ["row", "kind", "start", "end"]
    return rows.drop("hits"), spans.where("kind < 3").select(*place).unionByName(random.select(*place))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row.

    ``spans`` lists kind:start:end by start, then kind, joined by commas; ``base_sha256`` is the
    hash of that list with the base kinds alone. See ``secret_spans`` for what is found.
    """
    rows, spans = secret_spans(docs, id_col, text_col)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    told = spans.withColumn("said", F.concat_ws(":", name, "start", "end"))
    listed = lambda kept: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(kept, F.struct("start", "kind", "end", "said")))), lambda x: x["said"]), ",")
    number = lambda k: F.count(F.when(F.col("kind") == k, 1))
    per_row = told.groupBy("row").agg(
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        listed(F.col("kind") < 3).alias("base"), listed(F.lit(True)).alias("spans"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(per_row, "row", "left").select(
        "doc_id", *[zero(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``secret_spans`` replaced by ``mark`` and n_chars renewed.

    Touching and overlapping spans become one mark. Rows without a span come back as they are,
    null texts too; repeated rows share one result; all other columns are kept whatever their names. A
    row's text moves only in the join that brings its cuts.
    """
    rows, spans = secret_spans(docs)
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    done = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    cuts = spans.withColumn("done", done).withColumn("marks", (F.col("start") > F.col("done")) | (
        F.row_number().over(order) == 1))
    per_row = cuts.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "done", "marks"))).alias("cuts"),
        F.max("end").alias("last"))
    per_text = rows.join(per_row, "row").dropDuplicates(["doc_id", "sign"]).select(
        F.col("doc_id").alias("_id"), F.col("sign").alias("_sign"), F.col("cuts").alias("_cuts"), F.col("last").alias("_last"))
    held = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_key"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_own", F.xxhash64("_text"))
    met = held.join(per_text, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sign")), "left")
    text, none = F.col("_text"), F.col("_cuts").isNull()
    piece = F.transform("_cuts", lambda x: F.concat(
        F.substring(text, (x["done"] + 1).cast("int"), F.greatest(x["start"] - x["done"], F.lit(0)).cast("int")),
        F.when(x["marks"], F.lit(mark)).otherwise(F.lit(""))))
    clean = F.when(none, F.col("_row.text")).otherwise(F.concat(
        F.array_join(piece, ""), F.substring(text, (F.col("_last") + 1).cast("int"), F.length(text))))
    made = {"text": F.col("_clean"), "n_chars": F.when(none, F.col("_row.n_chars")).otherwise(F.length("_clean"))
            if "n_chars" in docs.columns else None}
    return met.withColumn("_clean", clean).select(*[
        made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
