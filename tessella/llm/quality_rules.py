"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose score lies beyond a cutoff. Labelled good documents are the holdout. For each stratum (language) and rule the
cutoffs of a fixed grid are tested from lenient to strict, each by an exact binomial test of "the rule rejects more than the allowed share of
the good documents"; the first cutoff that isn't certified ends the sequence (fixed-sequence testing, which needs no correction along the
grid), and the last certified one is used. Rules and strata are corrected for: every test is at level delta / (rules * (strata + 1)).

The allowed share is `risk`, or in a stratum with few labels the least share that its number of labels could certify if none of them were
rejected, up to `most_risk`; it depends on the number of labels alone. A stratum where even that is more than most_risk takes the cutoffs
certified on the labels of all strata together, as long as no more than most_risk of its own good labels lie beyond them. So with probability
1 - delta no stratum with enough labels loses more than its allowed share of good documents to any rule, nor does the pool of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, source_columns, written

SYMBOLS = "[#*$%&|<>]"
#: The grid, set before any label is seen: rule, and its cutoffs from strict to lenient. A document is rejected where score > cutoff.
RULES: dict[str, tuple[int, ...]] = {
    "symbols_permille": (10, 20, 50, 100, 150, 200, 300),
    "dup_lines_permille": (100, 200, 300, 400, 500, 700),
    "repeat_words_permille": (50, 100, 150, 200, 250),
    "long_words_centi": (600, 650, 700, 750, 800, 900, 1000, 1200),
    "short_words_centi": (-400, -350, -300, -250, -200),
}
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is bound, a shared expression inside a lambda is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(all_words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that the text holds twice or more, the first occurrence included.

    Windows compare by a 64-bit hash of their words' hashes. Texts without a repeat stop at array_distinct; the others sort (hash, place).
    """

    def repeats(hashes: Column) -> Column:
        n = F.size(hashes)
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        covered = F.aggregate(
            let(pairs, places), start, lambda a, p: F.struct((p + width).alias("end"), (a["n"] + p + width - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"]
        )
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(covered)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    found = let(F.transform(all_words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), repeats))
    return F.when(F.size(all_words) < width, F.lit(0)).otherwise(found).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words as functions of the text."""
    text = F.coalesce(text, F.lit(""))
    solid = let(F.split(text, "\n", -1), lambda x: F.filter(x, lambda one: F.btrim(one, F.lit(SPACE)) != ""))
    counts = let(solid, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("rep")))
    return {
        "w": by_words,
        "l": counts,
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """Adds a struct `m` of the base counts, rule scores and base_failed to rows that have text."""
    out = docs.withColumns({f"__{k}": v for k, v in base_columns(F.col("text")).items()})
    per = lambda a, b, k: F.floor(a * k / F.greatest(b, F.lit(1))).cast("int")
    n, chars = F.col("__w.n").cast("long"), F.col("__word_chars")
    m = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), F.col("__n_symbols").alias("n_symbols"), F.col("__l.dup").cast("long").alias("n_dup_lines"), F.col("__w.rep").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (F.col("__w.rep") * 100 > n * MAX_REPEAT_PERCENT)).alias("base_failed"),
        per(F.col("__n_symbols"), chars, 1000).alias("symbols_permille"), per(F.col("__l.dup"), F.col("__l.n"), 1000).alias("dup_lines_permille"),
        per(F.col("__w.rep"), n, 1000).alias("repeat_words_permille"), per(chars, n, 100).alias("long_words_centi"), (-per(chars, n, 100)).alias("short_words_centi"),
    )
    return out.withColumn("m", m).drop("__w", "__l", "__word_chars", "__n_symbols")


def binomial_below(n: Column, k: Column, p: Column) -> Column:
    """log P(Bin(n, p) <= k), summed term by term in logarithms: exact up to rounding."""
    start = n * F.log1p(-p)
    odds = F.log(p) - F.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("t"), (F.greatest(a["s"], term) + F.log1p(F.exp(-F.abs(a["s"] - term)))).alias("s"))

    first = F.struct(start.cast("double").alias("t"), start.cast("double").alias("s"))
    return F.when(k < 1, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), first, step, lambda a: a["s"]))


def thresholds(scores: DataFrame, labels: DataFrame, risk: float, most_risk: float, delta: float) -> DataFrame:
    """A row for each stratum of scores: s, the cutoff of each rule (null: off). scores: doc_id, stratum, m.

    Documents with any label of good quality are good; labels without id or quality are left out. Only counts for each stratum are ordered.
    """
    good = source_columns(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1")
    held = scores.where(~F.col("m.base_failed")).join(good.select("doc_id"), "doc_id", "left_semi")
    sums = [F.sum((F.col(f"m.{r}") > c).cast("long")).alias(f"{r}_{i}") for r, grid in RULES.items() for i, c in enumerate(grid)]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    strata = scores.select(F.col("stratum").alias("s")).distinct().join(counts, F.col("s").eqNullSafe(F.col("stratum")), "left")
    strata = strata.withColumn("n", F.coalesce("n", F.lit(0)))
    strata = strata.withColumn("level", F.lit(delta) / ((F.count(F.when(F.col("n") > 0, 1)).over(_whole()) + 1) * len(RULES)))

    # a row for each stratum and cell of the grid
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cut"), F.coalesce(f"{r}_{i}", F.lit(0)).alias("k")) for r, grid in RULES.items() for i, c in enumerate(grid)]
    grid = strata.select("s", "n", "level", F.explode(F.array(*cells)).alias("c")).select("s", "n", "level", "c.*")
    cell = Window.partitionBy("rule", "i")
    grid = grid.withColumn("pool_n", F.sum("n").over(cell)).withColumn("pool_k", F.sum("k").over(cell))
    # with no rejection, n labels exclude a share p at this level where (1 - p) ** n <= level
    least = lambda n: F.when(n > 0, 1 - F.exp(F.log("level") / n)).otherwise(F.lit(1.0))
    grid = grid.withColumn("share", F.greatest(F.lit(risk), least(F.col("n")))).withColumn("pool_share", F.greatest(F.lit(risk), least(F.col("pool_n"))))

    lenient_first = Window.partitionBy("s", "rule").orderBy(F.desc("i"))
    for of in ("", "pool_"):
        n, k, p = F.col(f"{of}n"), F.col(f"{of}k"), F.col(f"{of}share")
        few = (p <= most_risk) & (k <= n * p)
        safe = F.when(few, binomial_below(n, k, p) <= F.log("level") + 1e-9).otherwise(F.lit(False))
        grid = grid.withColumn(f"{of}ok", F.min(safe).over(lenient_first))
    rule = Window.partitionBy("s", "rule")
    grid = grid.withColumn("pool_cut", F.min(F.when(F.col("pool_ok"), F.col("cut"))).over(rule))
    pooled = (F.col("cut") >= F.col("pool_cut")) & (F.col("k") <= F.col("n") * most_risk)
    grid = grid.withColumn("used", F.when(F.col("share") <= most_risk, F.col("ok")).otherwise(pooled))
    return grid.groupBy("s").agg(*[F.min(F.when((F.col("rule") == r) & F.col("used"), F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def _whole():
    """Over all strata: one row for each."""
    return Window.partitionBy()


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds kept: not base_failed and no rule's score beyond its stratum's cutoff. Strata without a row in cuts have no rules."""
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | F.coalesce(F.col(f"m.{r}") > F.col(f"cut_{r}"), F.lit(False))
    joined = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    return joined.withColumn("kept", ~F.col("m.base_failed") & ~beyond).drop("s", *[f"cut_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.004, most_risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stratum and kept of every row.

    Null or empty text: all counts 0, base_failed. The stratum is lang (null is one). Repeated rows are judged one by one; where ids
    repeat, each labelled row counts in the holdout. Empty documents: empty result; empty labels: only the base rules. One pass over the
    texts; narrow rows meet the labels, and a few counts for each stratum decide.
    """
    rows = measured(source_columns(docs, "doc_id", "text", "lang")).select("doc_id", F.col("lang").alias("stratum"), "m")
    rows = written(rows, "quality")
    out = judged(rows, thresholds(rows, labels, risk, most_risk, delta))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in names], "stratum", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.004, most_risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that quality_rules keeps, same columns; rows with nulls, repeated rows and empty tables as there.

    Texts are measured once and written with their scores; no text is shuffled.
    """
    rows = measured(docs.select(F.struct("*").alias("row"), F.col("text"))).drop("text").withColumn("stratum", F.col("row.lang"))
    rows = written(rows, "quality")
    scores = rows.select(F.col("row.doc_id").alias("doc_id"), "stratum", "m")
    return judged(rows, thresholds(scores, labels, risk, most_risk, delta)).where("kept").select("row.*")
