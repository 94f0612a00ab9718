"""Quality rules whose cutoffs come with a guarantee, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.shared import FEW_FILES, Store, text_key

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"
#: Rules: the name and an integer score from 0 to 100 of the counts; more is worse.
RULES = {
    "symbols": "least(100, 100 * n_symbols div greatest(n_words, 1))",
    "duplicate_lines": "100 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "100 * n_repeat_words div greatest(n_words, 1)",
    "long_words": "least(100, 5 * word_chars div greatest(n_words, 1))",
    "short_words": "least(100, 200 * n_words div greatest(word_chars, 1))",
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(positions: Column) -> Column:
    """Words in windows of 8 words that start at the sorted positions."""
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-8).alias("last"))
    step = lambda a, x: F.struct((a["c"] + F.least(F.lit(8), x - a["last"])).alias("c"), x.alias("last"))
    return F.aggregate(positions, start, step, lambda a: a["c"])


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce((F.get(s, j - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, j + 1)["h"] == x["h"]), F.lit(False))
        return _covered(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(placed, marked))


def counts(text: Column) -> Column:
    """A struct of the base counts of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(x: Column) -> Column:
        w, n = x["words"], F.size(x["words"])
        starts = F.sequence(F.lit(1), n - 7)
        repeats = F.when(n < 8, F.lit(0).cast("long")).otherwise(_let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, 8))), _repeated))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            F.size(x["lines"]).cast("long").alias("n_lines"),
        )

    return _let(F.struct(words.alias("words"), lines.alias("lines")), of)


def _ln_factorial(n: str) -> str:
    """ln(n!) in SQL; Stirling's series from 15 on, good to the last digits of a double."""
    series = f"{n} * ln({n}) - {n} + 0.5D * ln(6.283185307179586D * {n}) + 1D / (12D * {n}) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5)) - 1D / (1680D * pow({n}, 7))"
    return f"CASE WHEN {n} < 15 THEN ln(CAST(factorial(CAST(least({n}, 14) AS INT)) AS DOUBLE)) ELSE {series} END"


def binomial_tail(k: str, n: str, p: str) -> str:
    """SQL for P(X <= k) of a binomial variable, for k below n * p; 1 otherwise.

    The sum runs downward from k, where the terms fall, until they are below
    1e-17 of the largest.
    """
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    top = f"exp({_ln_factorial(n)} - ({_ln_factorial(k)}) - ({_ln_factorial(f'({n} - {k})')}) + {k} * ln({p}) + ({n} - {k}) * ln(1D - {p}))"
    steps = f"sequence(0, CAST(least({k}, 60D + 12D * sqrt({n} * {p})) AS INT))"
    fold = f"aggregate({steps}, named_struct('t', 1D, 's', 0D), (a, i) -> named_struct('t', a.t * ({k} - i) / ({n} - {k} + i + 1D) * (1D - {p}) / {p}, 's', a.s + a.t), a -> a.s)"
    return f"CASE WHEN {k} < {n} * {p} THEN ({top}) * ({fold}) ELSE 1D END"


def cutoffs(scored: DataFrame, *, limit: float, risk: float) -> DataFrame:
    """stratum, rule, n (labelled good texts), cutoff, false_rejections and p_value.

    scored: stratum, text_id, good and a score for each rule, of labelled
    documents; a text that occurs often counts once, as good if any label says
    so. A rule rejects scores above its cutoff. In each stratum each rule may
    reject a share limit / rules of good texts; its cutoff is the lowest that an
    exact binomial test shows to keep that share. Cutoffs are tested from the
    loosest down (a fixed sequence, which needs no correction), rules and strata
    by Bonferroni, so with probability 1 - risk every stratum loses at most
    `limit` of its good texts. Without enough labels the cutoff is 100, which
    rejects nothing.
    """
    texts = scored.groupBy("stratum", "text_id").agg(F.max("good").alias("good"), *[F.max(r).alias(r) for r in RULES]).where("good")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("int").alias("score")) for r in RULES]))
    bins = texts.select("stratum", each.alias("x")).groupBy("stratum", "x.rule", "x.score").agg(F.count("*").alias("c"))
    by_bin = bins.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("score", "c"))).alias("at"), F.sum("c").alias("n"))
    many = by_bin.crossJoin(F.broadcast(by_bin.agg(F.greatest(F.countDistinct("stratum"), F.lit(1)).alias("strata"))))
    above = "aggregate(map_keys(at), 0L, (a, s) -> a + IF(s > c, at[s], 0L))"
    tried = many.select("stratum", "rule", "n", "strata", F.expr(f"explode(transform(sequence(0, 100), c -> named_struct('c', c, 'k', {above})))").alias("y"))
    tried = tried.select("stratum", "rule", "n", "strata", F.col("y.c").alias("cutoff"), F.col("y.k").alias("false_rejections"))
    share = f"CAST({limit / len(RULES)!r} AS DOUBLE)"
    tested = tried.withColumn("p_value", F.expr(binomial_tail("false_rejections", "n", share)))
    passing = tested.where(F.expr(f"p_value <= {risk!r} / (strata * {len(RULES)}) OR cutoff = 100"))
    best = passing.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n", "false_rejections", "p_value")).alias("b"))
    return best.select("stratum", "rule", "b.n", "b.cutoff", "b.false_rejections", "b.p_value")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, limit: float, risk: float, name: str, row: list[Column]) -> DataFrame:
    """Counts and verdict of every row, with the columns `row`."""
    store = Store(docs.sparkSession, name)
    rows = docs.select(*row, F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("rid"), F.xxhash64(text_col).alias("text_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), counts(F.col(text_col)).alias("q"))
    kept = [c for c in rows.columns if c not in ("q", "text_id")]
    base = rows.select(*kept, "text_id", *[F.col(f"q.{c}").alias(c) for c in _COUNTS])
    base = base.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    base = store.keep(base.withColumns({r: F.expr(e) for r, e in RULES.items()}))
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    found = store.put(cutoffs(base.select("doc_id", "text_id", "stratum", *RULES).join(marks, "doc_id"), limit=limit, risk=risk), small=True)
    by_stratum = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    # verdicts cost little: few tasks, as each makes a file
    out = base.coalesce(FEW_FILES * docs.sparkSession.sparkContext.defaultParallelism // 2).join(by_stratum, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.element_at("cut", F.lit(r)), F.lit(r)) for r in RULES]))
    failed = F.coalesce(failed, F.array().cast("array<string>"))
    return out.select(*kept, *_COUNTS, "base_failed", failed.alias("failed_rules")).withColumn("kept", F.expr("NOT base_failed AND size(failed_rules) = 0"))


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", *, limit: float = 0.02, risk: float = 0.05, name: str = "quality") -> DataFrame:
    """Counts and verdict of every row: doc_id, rid, the counts, base_failed, failed_rules and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows. kept: not base_failed and no score above its cutoff (see
    cutoffs); a stratum without labels has no cutoffs. labels: doc_id, quality
    (1 good); null labels say nothing. Null or empty text: no words. Repeated
    rows get the same verdict, null ids and strata take part, ties with a cutoff
    stay, other columns are ignored, an empty table gives an empty result.
    """
    return _judged(docs, labels, id_col, text_col, stratum_col, limit, risk, name, []).drop("stratum")


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", *, limit: float = 0.02, risk: float = 0.05, name: str = "quality") -> DataFrame:
    """The rows that `rules` keeps, with all their columns. They travel with their counts, so texts are not shuffled."""
    # fields by number: names of other columns may clash in any way
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    out = _judged(docs, labels, id_col, text_col, stratum_col, limit, risk, name, [row]).where("kept")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
