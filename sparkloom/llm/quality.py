"""Quality rules whose cutoffs adapt to each language and source.

Every text's rates (symbols, repeated lines, repeated words, by the thousand) are sketched per language and source:
a sketch counts values rounded down to five significant bits, so that it holds each quantile to within one part in
sixteen, its size is bounded, and sketches of parts of a group add up to the group's. A group's cutoff for a rate is
an upper quantile of its sketch plus SPREAD times the distance between that quantile and the median; what is usual in a
group passes there. Small groups lean on their language, and small languages on all texts: into each sketch that of the
wider group is mixed, with the weight of PRIOR texts in all. As rates are held by the thousand, a text at
the cutoff may have up to cutoff + 1 by the thousand of its length; a text is dropped if it has more than a text of
that rate would by chance, SPREAD standard deviations above (of square roots of counts, whose deviation is 1/2 at any
rate). So a few in a short text are no evidence, by its length and its group's rate alone. Cutoffs are joined to the
texts and applied.

Only DataFrame functions are used. Null texts have no words and fail; null languages and sources are groups of
their own. Long texts are measured whole; repeated rows count each time. An empty table has no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Scratch, key_of, small

SYMBOLS = "#*$%&|<>"
#: Of each rate: what is counted, and among how many; and the percentile that its cutoff starts from.
RATES = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
LEVELS = {"symbols": 85, "lines": 95, "repeats": 95}
SPREAD = 3
#: Texts that the wider group's sketch counts as, and the parts that a text is weighed in.
PRIOR, UNIT = 50, 1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(docs: DataFrame, words: str) -> DataFrame:
    """docs with __q_repeats: of the words of a column, those in three-word windows found twice or more. Each step is
    a column of its own, as a lambda's argument would be computed anew for each use."""
    out = docs.withColumn("__q_hashed", F.transform(words, lambda w: F.xxhash64(w)))
    most = F.greatest(F.size(words) - 2, F.lit(0))
    a, b, c = (F.slice("__q_hashed", i, most) for i in (1, 2, 3))
    out = out.withColumn("__q_windows", F.zip_with(F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)), c, lambda xy, z: F.xxhash64(xy, z))).drop("__q_hashed")
    placed = F.sort_array(F.transform("__q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__q_placed", F.when(F.size("__q_windows") > F.size(F.array_distinct("__q_windows")), placed)).drop("__q_windows")
    pairs = F.zip_with("__q_placed", F.slice("__q_placed", 2, F.size("__q_placed")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    twice = F.filter(pairs, lambda p: p["x"]["h"] == p["y"]["h"])
    at = F.sort_array(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["x"]["i"], p["y"]["i"])))))
    out = out.withColumn("__q_at", at).drop("__q_placed")
    gaps = F.zip_with("__q_at", F.slice("__q_at", 2, F.size("__q_at")), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    return out.withColumn("__q_repeats", F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, x: total + x), F.lit(0))).drop("__q_at")


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts of COUNTS, n_lines, n_distinct (words) and base_failed, each under prefix."""
    p = "__q_"
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"{p}words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), f"{p}lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))})
    out = _repeat_words(out, f"{p}words")
    counts = {
        "n_words": F.size(f"{p}words"),
        "word_chars": F.length(F.array_join(f"{p}words", "")),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines")),
        "n_repeat_words": F.col(f"{p}repeats"),
    }
    out = out.withColumns({f"{prefix}{k}": v.cast("long") for k, v in counts.items()} | {f"{prefix}n_lines": F.size(f"{p}lines").cast("long"), f"{prefix}n_distinct": F.size(F.array_distinct(f"{p}words")).cast("long")})
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.drop(f"{p}words", f"{p}lines", f"{p}repeats").withColumn(f"{prefix}base_failed", (n < 50) | (100 * r > 50 * n))


def rates(prefix: str = "") -> dict[str, Column]:
    """The rates by the thousand, rounded down."""
    return {k: F.coalesce(F.floor(F.try_divide(F.col(f"{prefix}{x}") * 1000, F.col(f"{prefix}{of}"))), F.lit(0)) for k, (x, of) in RATES.items()}


def rounded(value: Column) -> Column:
    """value to five significant bits, rounded down."""
    step = F.lit(1)
    for bits in range(6, 12):
        step = F.when(value >= 1 << (bits - 1), F.lit(1 << (bits - 5))).otherwise(step)
    return value - value % step


def sketch(measured: DataFrame, lang: Column, source: Column, prefix: str = "") -> DataFrame:
    """A row per language, source, rate and rounded value, with the count of texts that pass the base rules.
    Sketches are merged by adding their counts."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), rounded(v).alias("value")) for k, v in rates(prefix).items()]))
    rows = measured.where(~F.col(f"{prefix}base_failed")).select(key_of(lang).alias("lang_key"), key_of(source).alias("source_key"), kinds.alias("k"))
    return rows.groupBy("lang_key", "source_key", "k.rate", "k.value").agg(F.count("*").alias("n"))


def cutoffs(sketches: DataFrame) -> DataFrame:
    """Of every language and source in sketches: the cutoff of each rate, from its own sketch with its language's
    mixed in, into which that of all is mixed. A group has a row for each value of a sketch, of which there are few."""

    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("rate"))

    def counted(keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        of_value = sketches.groupBy(*keys, "rate", "value").agg(F.sum("n").alias(f"{name}_n"))
        return of_value, of_value.groupBy(*keys, "rate").agg(F.sum(f"{name}_n").alias(f"{name}_texts"))

    of_all, all_texts = counted([], "a")
    of_lang, lang_texts = counted(["lang_key"], "l")
    group = ["lang_key", "source_key", "rate"]
    values = sketches.select(*group).distinct().join(F.broadcast(of_all.join(all_texts, "rate")), "rate")  # a row per value
    values = values.join(lang_texts, ["lang_key", "rate"]).join(of_lang, ["lang_key", "rate", "value"], "left").join(sketches, [*group, "value"], "left")
    wider = (F.coalesce("l_n", F.lit(0)) + PRIOR * F.col("a_n") / F.col("a_texts")) / (F.col("l_texts") + PRIOR)
    weighed = values.withColumn("weight", F.floor(UNIT * (F.coalesce("n", F.lit(0)) + PRIOR * wider)))
    of_group = W.partitionBy(*group)
    ranked = weighed.withColumns({"below": F.sum("weight").over(of_group.orderBy("value")), "total": F.sum("weight").over(of_group)})
    at = lambda percent: F.min(F.when(F.col("below") * 100 >= F.col("total") * percent, F.col("value")))
    found = ranked.groupBy(*group).agg(at(50).alias("middle"), at(level).alias("high"))
    named = found.withColumn("cut", F.col("high") + SPREAD * (F.col("high") - F.col("middle")))
    return named.groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("rate") == k, F.col("cut"))).alias(f"__cut_{k}") for k in RATES])


def judge(measured: DataFrame, lang: Column, source: Column, prefix: str, scratch: Scratch) -> DataFrame:
    """measured with the column <prefix>kept. measured is read twice and should be a written table. A group without a
    cutoff has no text that passes the base rules."""
    cuts = scratch.write(cutoffs(sketch(measured, lang, source, prefix)), "cutoffs").withColumnsRenamed({"lang_key": "__lang_key", "source_key": "__source_key"})
    joined = measured.withColumns({"__lang_key": key_of(lang), "__source_key": key_of(source)}).join(small(cuts), ["__lang_key", "__source_key"], "left")
    fine = F.lit(True)
    for k, (counted, of) in RATES.items():
        most = F.sqrt(F.col(f"{prefix}{of}") * (F.col(f"__cut_{k}") + 1) / 1000) + SPREAD / 2
        fine = fine & (F.col(f"{prefix}{counted}") <= most * most)
    drop = ["__lang_key", "__source_key", *(f"__cut_{k}" for k in RATES)]
    return joined.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.coalesce(fine, F.lit(False))).drop(*drop)


def annotate(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = measure(docs.select("doc_id", "text", "lang", "source")).drop("text")
    judged = judge(scratch.write(measured, "measured"), F.col("lang"), F.col("source"), "", scratch)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs' rows that are kept, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.write(measure(docs, prefix="__m_"), "measured")
    return judge(measured, F.col("lang"), F.col("source"), "__m_", scratch).where("__m_kept").select(*docs.columns)
