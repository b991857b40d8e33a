"""Quality rules with risk-controlled cutoffs.

A rule is a score per document, large when the document is bad; it rejects scores above a cutoff. The cutoffs are not
hand-picked: a labelled holdout decides per stratum which of a fixed grid may be used. Going from the strictest cutoff
down, a cutoff is certified while the exact binomial tail P(Bin(n, risk) <= rejected) of the good documents stays at or
below ``delta`` divided by the number of (stratum, rule) pairs (Bonferroni across pairs, fixed-sequence testing within
one). So with probability 1 - delta every certified rule wrongly rejects at most ``risk / rules`` of the good documents
of its stratum, and all rules together at most ``risk``. Of the certified cutoffs the one that parts bad from good best is used.
A stratum without enough labels gets no cutoff and loses no document to the rules.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedwright.llm.common import packed, query, table, unpacked
from feedwright.staging import stage

SPACE = r"[\x20\x09-\x0D]+"
STRATA = ("de", "en", "es", "fr")
RISK = 0.05
DELTA = 0.05
MIN_WORDS = 50
CUTOFFS = (4.0, 2.0, 1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)
# name -> score over the counts; the same text is SQL for Spark and DuckDB.
RULES = {
    "symbols": "cast(n_symbols as double) / n_words",
    "repeats": "cast(n_repeat_words as double) / n_words",
    "dup_lines": "cast(n_dup_lines as double) / n_lines",
    "upper": "cast(n_upper as double) / word_chars",
    "exclaims": "cast(n_exclaims as double) / n_words",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    window = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def repeated(rows: Column) -> Column:
            twin = lambda x, i: (F.get(rows, i - 1)["h"] == x["h"]) | (F.get(rows, i + 1)["h"] == x["h"])
            return F.sort_array(F.filter(F.transform(rows, lambda x, i: F.when(twin(x, i), x["p"])), lambda p: p.isNotNull()))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        many = let(let(by_hash, repeated), length)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(many)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(window, covered)).cast("long")


def counts(text: Column) -> Column:
    """Struct of the counts of one whole text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    return F.struct(
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        without("!").alias("n_exclaims"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )


COUNTS = {
    "n_words": "words.n_words",
    "word_chars": "word_chars",
    "n_symbols": "n_symbols",
    "n_dup_lines": "lines.n_dup_lines",
    "n_repeat_words": "words.n_repeat_words",
    "n_lines": "lines.n_lines",
    "n_upper": "n_upper",
    "n_exclaims": "n_exclaims",
}


def measured(rows: DataFrame, text: str, lang: str, strata: Sequence[str] = STRATA) -> DataFrame:
    """``rows`` with the counts, stratum, base_failed and scores (an array in the order of RULES)."""
    found = rows.withColumn("_counts", counts(F.col(text)))
    found = found.withColumns({name: F.col(f"_counts.{path}") for name, path in COUNTS.items()}).drop("_counts")
    scores = F.array(*[F.coalesce(F.expr(f"case when n_words > 0 then {rule} end"), F.lit(0.0)) for rule in RULES.values()])
    return found.withColumns(
        {
            "stratum": F.when(F.col(lang).isin(*strata), F.col(lang)).otherwise("other"),
            "base_failed": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"),
            "scores": scores,
        }
    )


def binomial_tail(rejected: Column, good: Column, risk: float) -> Column:
    """P(Bin(good, risk) <= rejected), exactly summed in logarithms; 1 where it must be over one half."""
    first = good * F.log1p(F.lit(-risk))
    odds = F.log(F.lit(risk)) - F.log1p(F.lit(-risk))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((good - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    start = F.struct(first.alias("term"), F.exp(first).alias("total"))
    terms = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<bigint>"))
    return F.when(rejected > risk * good, F.lit(1.0)).otherwise(F.aggregate(terms, start, add, lambda acc: acc["total"]))


def certified_cutoffs(
    rows: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA, n_strata: int = len(STRATA) + 1
) -> DataFrame:
    """(stratum, cutoffs: rule -> cutoff) from measured ``rows`` (doc_id, digest, stratum, base_failed, scores) and labels.

    A document with contradictory labels is left out; copies of one text in a stratum count once, with their lowest
    label. At most one row per stratum and one entry per rule come back, whatever the size of the holdout.
    """
    quality = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where("quality = _most and quality in (0, 1)")
        .drop("_most")
    )
    holdout = (
        rows.where("not base_failed")
        .join(quality, "doc_id")
        .groupBy("stratum", "digest")
        .agg(F.min("quality").alias("quality"), F.max("scores").alias("scores"))
    )
    cutoffs = F.array(*[F.lit(cutoff) for cutoff in CUTOFFS])
    per_rule = holdout.select(
        "stratum", "quality", F.posexplode(F.transform("scores", lambda s: F.size(F.filter(cutoffs, lambda c: s > c))))
    ).toDF("stratum", "quality", "rule", "passed")
    # A score above the i-th lowest cutoffs is above all lower ones: histogram first, running totals over a few rows.
    cells = per_rule.groupBy("stratum", "rule", "passed").agg(
        F.sum(F.col("quality").cast("long")).alias("good"), F.sum((1 - F.col("quality")).cast("long")).alias("bad")
    )
    pair = Window.partitionBy("stratum", "rule")
    grid = cells.groupBy("stratum", "rule").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads")).withColumn(
        "level", F.explode(F.sequence(F.lit(1), F.lit(len(CUTOFFS))))
    )
    # Level 1 is the strictest cutoff: a score passes it if it passed all cutoffs.
    over = grid.join(cells, ["stratum", "rule"]).where(F.col("passed") >= len(CUTOFFS) - F.col("level") + 1)
    over = over.groupBy("stratum", "rule", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tested = grid.join(over, ["stratum", "rule", "level"], "left").fillna(0, ["good", "bad"])
    risk_each = risk / len(RULES)
    level = delta / (n_strata * len(RULES))
    passed = binomial_tail(F.col("good"), F.col("goods"), risk_each) <= level
    certified = tested.withColumn(
        "_ok", F.min(passed.cast("int")).over(pair.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    ).where("_ok = 1 and bad > 0")
    gain = F.col("bad") / F.greatest("bads", F.lit(1)) - F.col("good") / F.greatest("goods", F.lit(1))
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), (-F.col("level")).alias("level"))).alias("best"))
    names = F.array(*[F.lit(name) for name in RULES])
    entry = F.struct(names[F.col("rule")], F.element_at(cutoffs, (-F.col("best.level")).cast("int")))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(entry)).alias("cutoffs"))


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Measured rows with ``rejected_by`` (rules whose cutoff is exceeded) and ``kept``."""
    # One row per stratum, at most len(strata) + 1 of them.
    joined = rows.join(F.broadcast(cutoffs), "stratum", "left")
    failing = F.array_compact(
        F.array(*[F.when(F.col("scores")[k] > F.col("cutoffs")[name], F.lit(name)) for k, name in enumerate(RULES)])
    )
    return joined.withColumn("rejected_by", failing).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)
    )


def calibrate(docs: DataFrame, labels: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **options):
    """(measured narrow rows, certified cutoffs); counts are made once and staged without the texts."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(lang).alias("lang"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        F.col(text).alias("text"),
    )
    rows = stage(measured(narrow, "text", "lang").drop("text"), "measured")
    return rows, stage(certified_cutoffs(rows, labels, **options), "cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and every certified cutoff of their stratum.

    A null text has no words and is rejected; a null or unknown language is stratum ``other``; repeated rows are judged
    alike; without labels only the base rule acts.
    """
    _, cutoffs = calibrate(docs, labels, text=text, lang=lang, doc_id=doc_id, **options)
    rows = measured(packed(docs, text, lang), f"in_{text}", f"in_{lang}")
    return unpacked(judged(rows, cutoffs).where("kept"), docs.columns)


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    blank = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    strata = ", ".join(f"'{name}'" for name in STRATA)
    rules = ", ".join(f"({k}, '{name}')" for k, name in enumerate(RULES))
    scores = "\n    union all ".join(
        f"select rid, stratum, t, {k} as rule, coalesce(case when n_words > 0 then {rule} end, 0.0) as score from c where not base_failed"
        for k, rule in enumerate(RULES.values())
    )
    grid = ", ".join(f"({level}, cast({cutoff} as double))" for level, cutoff in enumerate(CUTOFFS, 1))
    each, alpha = RISK / len(RULES), DELTA / (len(RULES) * (len(STRATA) + 1))
    return f"""
with d as (
    select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
win as (select rid, p, array_to_string(w[p : p + 2], ' ') as s
        from (select rid, w, unnest(range(1, len(w) - 1)) as p from d where len(w) >= 3)),
rep as (
    select rid, count(distinct q) as n from (
        select rid, unnest(range(p, p + 3)) as q
        from win join (select rid, s from win group by rid, s having count(*) > 1) using (rid, s)) group by rid),
lines as (
    select rid, count(*) as n, count(distinct l) as u from (select rid, unnest(string_split(t, chr(10))) as l from d)
    where length(translate(l, {blank}, '')) > 0 group by rid),
c0 as (
    select rid, doc_id, t, case when lang in ({strata}) then lang else 'other' end as stratum,
           cast(len(w) as bigint) as n_words, cast(length(translate(t, {blank}, '')) as bigint) as word_chars,
           cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
           cast(coalesce(lines.n - lines.u, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
           coalesce(lines.n, 0) as n_lines, length(t) - length(translate(t, '!', '')) as n_exclaims,
           length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) as n_upper
    from d left join rep using (rid) left join lines using (rid)),
c as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from c0),
sc as ({scores}),
q as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id
      having min(quality) = max(quality) and min(quality) in (0, 1)),
hold as (select stratum, rule, t, min(quality) as quality, max(score) as score
         from sc join (select rid, doc_id from c) using (rid) join q using (doc_id) group by stratum, rule, t),
grid(level, cutoff) as (values {grid}),
tested as (
    select stratum, rule, level, cutoff, count(*) filter (quality = 1) as goods, count(*) filter (quality = 0) as bads,
           count(*) filter (quality = 1 and score > cutoff) as good, count(*) filter (quality = 0 and score > cutoff) as bad
    from hold, grid group by all),
tail as (
    select *, case when good > {each} * goods then 1.0 else list_sum(list_transform(range(0, good + 1), lambda i:
        exp(case when goods > 0 then lgamma(goods + 1) - lgamma(i + 1) - lgamma(goods - i + 1) else 0 end
            + i * ln({each}) + (goods - i) * ln(1 - {each})))) end as p
    from tested),
ok as (select *, max(p) over (partition by stratum, rule order by level) as worst from tail),
best as (
    select stratum, rule, arg_max(cutoff, row(bad / greatest(bads, 1) - good / greatest(goods, 1), -level)) as cutoff
    from ok where worst <= {alpha!r} and bad > 0 group by stratum, rule),
rejected as (select distinct rid from sc join best using (stratum, rule) where score > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and rejected.rid is null as kept
from c left join rejected using (rid)
"""


@query("op1_quality_rules", _oracle())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    rows, cutoffs = calibrate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged(rows, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
