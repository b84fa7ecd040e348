"""Quality rules whose cutoffs are chosen under a guaranteed bound on false rejections. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.common import GAP_CHARS, GAP_RE, WORD_RE, fresh, staged

# Per rule: the measure and its cutoffs from lenient to strict. A text is rejected above a cutoff. Repeated runs have no rule here:
# the base rules reject above 20% of them.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "long_words": ("word_chars / n_words", (40.0, 25.0, 15.0, 12.0, 10.0)),
}
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
RUN = 5


def _run_hashes(words: str, size: str) -> str:
    """SQL: one hash for each run of five words, by position."""
    items = ", ".join(f"get({words}, i + {k})" if k else f"get({words}, i)" for k in range(RUN))
    return f"CASE WHEN {size} >= {RUN} THEN transform(sequence(0, {size} - {RUN}), i -> xxhash64({items})) ELSE array() END"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``measures``; all of it is computed inside the row, nothing is shuffled.

    Repeated runs are found by hash: if a text has as many distinct run hashes as runs there are none
    (most texts, linear time). Else the (hash, position) pairs are sorted, positions whose hash has an
    equal neighbour are repeated, and the words they cover are summed over the sorted positions, so a
    very long text of copies stays at n log n.
    """
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = {n: fresh(docs, f"__{n}") for n in ("text", "trim", "words", "size", "hashes", "runs", "repeated", "sorted", "places")}
    g = {n: f"`{c}`" for n, c in names.items()}
    df = docs.withColumn(names["text"], source)
    df = df.withColumn(names["trim"], F.btrim(F.col(names["text"]), F.lit(GAP_CHARS)))
    df = df.withColumn(names["words"], F.expr(f"CASE WHEN {g['trim']} = '' THEN CAST(array() AS array<string>) ELSE split({g['trim']}, r'{GAP_RE}', -1) END"))
    df = df.withColumn(names["hashes"], F.expr(f"transform({g['words']}, w -> xxhash64(w))")).withColumn(names["size"], F.expr(f"size({g['words']})"))
    df = df.withColumn(names["runs"], F.expr(_run_hashes(g["hashes"], g["size"])))
    df = df.withColumn(names["repeated"], F.expr(f"size(array_distinct({g['runs']})) < size({g['runs']})"))
    df = df.withColumn(
        names["sorted"],
        F.expr(f"CASE WHEN {g['repeated']} THEN sort_array(transform({g['runs']}, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    df = df.withColumn(
        names["places"],
        F.expr(
            f"sort_array(transform(filter({g['sorted']}, (x, k) -> coalesce(get({g['sorted']}, k - 1).h = x.h, false) "
            f"OR coalesce(get({g['sorted']}, k + 1).h = x.h, false)), x -> x.i))"
        ),
    )
    lines = f"filter(split({g['text']}, '\\n', -1), l -> l RLIKE r'{WORD_RE}')"
    covered = (
        f"CASE WHEN {g['repeated']} THEN {RUN} + aggregate(sequence(1, size({g['places']}) - 1), 0L, "
        f"(sum, k) -> sum + least({RUN}, get({g['places']}, k) - get({g['places']}, k - 1))) ELSE 0L END"
    )
    packed = F.struct(
        F.col(names["size"]).cast("bigint").alias("n_words"),
        F.expr(f"CAST(char_length({g['text']}) - regexp_count({g['text']}, r'[\\x20\\x09-\\x0D]') AS bigint)").alias("word_chars"),
        F.expr(f"CAST(regexp_count({g['text']}, r'[#*$%&|<>]') AS bigint)").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> struct(CAST(size(l) AS bigint) AS n, CAST(size(l) - size(array_distinct(l)) AS bigint) AS d))[0]").alias("lines"),
        F.expr(f"CAST({covered} AS bigint)").alias("n_repeat_words"),
    )
    raw, out = fresh(docs, "__raw"), fresh(docs, "measures")
    df = df.select(*[F.col(f"`{c}`") for c in docs.columns], packed.alias(raw))
    r = f"`{raw}`"
    final = f"struct({r}.n_words, {r}.word_chars, {r}.n_symbols, {r}.lines.n AS n_lines, {r}.lines.d AS n_dup_lines, {r}.n_repeat_words)"
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.expr(final).alias(out))


def base_failed(measured: str = "measures") -> Column:
    m = F.col(measured)
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def rule_value(rule: str, measured: str = "measures") -> Column:
    """The measure of a rule; null (never rejected) where its divisor is zero."""
    over, under = RULES[rule][0].split(" / ")
    m = F.col(measured)
    return F.when(m[under] > 0, m[over] / m[under])


def lower_tail(k: str, n: str, p: str) -> Column:
    """P(X <= k) of a binomial(n, p), exact up to rounding, summed in logarithms so that no term underflows.

    At k >= n * p the tail is near or above one half; 1 is returned there, which fails any test.
    """
    return F.expr(
        f"CASE WHEN {k} >= {n} * {p} THEN 1.0D ELSE exp(aggregate(sequence(0L, {k}), "
        f"struct(CAST({n} * ln(1 - {p}) AS double) AS term, CAST(NULL AS double) AS sum), "
        f"(a, i) -> struct(CASE WHEN i = 0 THEN a.term ELSE a.term + ln(({n} - i + 1) / i) + ln({p} / (1 - {p})) END AS term, "
        f"CASE WHEN i = 0 THEN a.term ELSE "
        f"greatest(a.sum, a.term + ln(({n} - i + 1) / i) + ln({p} / (1 - {p}))) + "
        f"ln(1 + exp(-abs(a.sum - (a.term + ln(({n} - i + 1) / i) + ln({p} / (1 - {p})))))) END AS sum), a -> a.sum)) END"
    )


def certified_cutoffs(holdout: DataFrame, stratum: str, risk: float = 0.04, error: float = 0.05, price: float = 10.0) -> DataFrame:
    """The cutoff of each (stratum, rule) that is certified and pays; columns stratum, rule, cutoff, n_good, n_false.

    ``holdout`` has the stratum, the measures and ``quality`` (1 good, 0 bad). Guarantee: with
    probability 1 - ``error`` over the holdout, in every stratum at once, the chosen cutoffs together
    reject at most a share ``risk`` of good documents. Each rule may spend ``risk`` / number of rules. A
    cutoff passes if the exact binomial tail of its false rejections at that rate is at most the level.
    Correction for many tests: each (stratum, rule) is a chain of cutoffs, tested in a fixed order, lenient
    to strict, up to the first that fails. Chains share the error by Holm: one that passes as a whole
    frees its share for the others, so chains are ordered by their worst tail and the j-th of m is held to
    ``error`` / (m - j + 1); those left open when the first does not pass as a whole are tested cutoff by
    cutoff at ``error`` / (number left open). Among passed cutoffs the one with the most bad minus ``price`` times good rejections is taken, ties to the lenient;
    a rule that gains nothing, or a stratum with too few labels, gets no cutoff and rejects nothing.
    """
    grid = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(float(cut)).alias("cutoff"), (F.coalesce(rule_value(rule) > cut, F.lit(False))).alias("out"))
        for rule, (_, cuts) in RULES.items()
        for step, cut in enumerate(cuts)
    ])
    # One row per (stratum, outcome vector) before the grid is laid out: a few hundred rows, however many labels there are.
    votes = holdout.select(F.col(stratum).alias("stratum"), "quality", grid.alias("grid")).groupBy("stratum", "quality", "grid").agg(F.count("*").alias("n"))
    votes = staged(votes, "votes")
    cells = votes.select("stratum", "quality", "n", F.inline("grid"))
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    cells = cells.groupBy("stratum", "rule", "step", "cutoff").agg(
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("n_good"),
        F.coalesce(F.sum(F.when(good & F.col("out"), F.col("n"))), F.lit(0)).alias("n_false"),
        F.coalesce(F.sum(F.when(bad & F.col("out"), F.col("n"))), F.lit(0)).alias("n_right"),
    )
    cells = cells.withColumn("p", F.lit(risk / len(RULES))).withColumn("tail", lower_tail("n_false", "n_good", "p"))
    # Strata times cutoffs rows, in one order for all of them.
    chain, everything = Window.partitionBy("stratum", "rule"), Window.partitionBy(F.lit(0))
    ranked = everything.orderBy("worst", "stratum", "rule")
    cells = cells.withColumn("worst", F.max("tail").over(chain)).withColumn("place", F.dense_rank().over(ranked))
    cells = cells.withColumn("chains", F.max("place").over(everything))
    whole = F.col("worst") <= F.lit(error) / (F.col("chains") - F.col("place") + 1)
    cells = cells.withColumn("whole", F.min(whole).over(everything.orderBy("place").rangeBetween(Window.unboundedPreceding, 0)))
    left_open = F.col("chains") - F.coalesce(F.max(F.when(F.col("whole"), F.col("place"))).over(everything), F.lit(0))
    cells = cells.withColumn("level", F.lit(error) / F.greatest(F.lit(1), left_open))
    in_order = chain.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("passed", F.col("whole") | F.min(F.col("tail") <= F.col("level")).over(in_order))
    gain = F.col("n_right") - price * F.col("n_false")
    cells = cells.where(F.col("passed") & (gain > 0)).withColumn("gain", gain)
    best = F.max_by(F.struct("cutoff", "n_good", "n_false"), F.struct("gain", -F.col("step"))).alias("best")
    return cells.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "best.*")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.04, error: float = 0.05) -> DataFrame:
    """key, measures, base_failed, kept of each document; ``labels`` (key, quality) is the holdout.

    A document is kept unless the base rules fail it or a measure is above the certified cutoff of its
    stratum. Measures are computed once, in one pass over the texts, and staged; labels, cutoffs and
    verdicts work on that narrow table. Cutoffs (strata times rules rows) are joined by stratum.

    Null or empty text: no words, so it fails. Null stratum: a stratum of its own. Labels with null key or
    quality are ignored, a key labelled twice counts as bad if any label says so, and labels without a
    document do nothing. Documents with the same key each get their own verdict, each counted in the
    holdout. No labels: only the base rules act. Other columns are not read.
    """
    measured = measures(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{text}`").alias("text")))
    measured = staged(measured.select("key", "stratum", "measures"), "measures")
    votes = labels.where(F.col("quality").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.min("quality").alias("quality"))
    # Base failures never reach the rules, so they tell nothing about what the rules reject.
    holdout = measured.where(~base_failed()).join(votes, "key")
    cuts = certified_cutoffs(holdout, "stratum", risk, error)
    cuts = staged(cuts.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")), "cutoffs")
    cuts = cuts.withColumnRenamed("stratum", "cut_stratum")
    judged = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(rule_value(rule) > F.col(rule), F.lit(False))
    return judged.select(F.col("key").alias(key), "measures", base_failed().alias("base_failed"), (~(base_failed() | over)).alias("kept"))
