"""Text cut off by field limits: discrete length hazards and incomplete endings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch

#: Stands for the end of a clause among the words of a text.
STOP = "¶"
#: Stands after the last word of a text.
END = "⏹"
#: All white space a text may end in.
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def length_hazards(docs: DataFrame, band: int = 40, fdr: float = 0.01, least: int = 5) -> DataFrame:
    """source, n_chars, n, at_risk, neighbour_hazard, p_bound, significant for every length that occurs.

    The hazard of a length is the share of the source's texts of at least that length that have
    exactly it. It is tested against the pooled hazard of all other lengths within ``band`` around it,
    those that no text has included. The tail probability is bounded by
    exp(-at_risk * KL(hazard, neighbours)), an upper bound, so the Benjamini-Hochberg step at ``fdr``
    over all lengths keeps its control. Only lengths with ``p_bound <= fdr`` can pass that step, and only
    they are ranked: within octaves of the probability, whose counts are summed first.
    """
    counts = docs.groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("source").orderBy(F.col("n_chars").cast("long"))
    near = by_length.rangeBetween(-band, band)
    risk = (
        counts.withColumn("at_risk", F.sum("n").over(by_length.rangeBetween(0, Window.unboundedFollowing)))
        .withColumn("in_band", F.sum("n").over(near))
        .withColumn("in_band_chars", F.sum(F.col("n") * F.col("n_chars")).over(near))
        .withColumn("beyond", F.coalesce(F.sum("n").over(by_length.rangeBetween(band + 1, Window.unboundedFollowing)), F.lit(0)))
    )
    # Every text of at least l - band is at risk at each length of the band up to its own.
    low = F.greatest(F.col("n_chars") - band, F.lit(1))
    exposed = F.col("in_band_chars") - F.col("in_band") * (low - 1) + F.col("beyond") * (F.col("n_chars") + band - low + 1)
    pooled = risk.withColumn("near_n", F.col("in_band") - F.col("n")).withColumn("near_risk", exposed - F.col("at_risk"))
    h = F.col("n") / F.col("at_risk")
    p = F.greatest(F.lit(1e-9), (F.col("near_n") + 0.5) / (F.col("near_risk") + 1.0))
    p = F.least(p, F.lit(0.999999))
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    kl = part(F.col("h"), F.col("p")) + part(1 - F.col("h"), 1 - F.col("p"))
    tested = pooled.withColumn("h", h).withColumn("p", p).withColumn("log_p", F.when(F.col("h") > F.col("p"), -F.col("at_risk") * kl).otherwise(0.0))
    tests = counts.agg(F.count(F.lit(1)).alias("m"))
    hopeful = tested.where(F.col("log_p") <= math.log(fdr)).select("log_p", F.least(F.floor(-F.col("log_p")), F.lit(1000)).alias("octave"))
    sizes = hopeful.groupBy("octave").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("octave", (F.sum("k").over(Window.orderBy(F.desc("octave"))) - F.col("k")).alias("before"))
    ranked = hopeful.join(F.broadcast(before), "octave").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("octave").orderBy("log_p")))
    cut = ranked.crossJoin(F.broadcast(tests)).where(F.col("log_p") <= F.log(F.col("rank") * fdr / F.col("m"))).agg(F.max("log_p").alias("cut"))
    out = tested.crossJoin(F.broadcast(cut))
    significant = (F.col("log_p") <= F.coalesce("cut", F.lit(float("-inf")))) & (F.col("n") >= least)
    return out.select("source", "n_chars", "n", "at_risk", F.col("p").alias("neighbour_hazard"), F.exp("log_p").alias("p_bound"), significant.alias("significant"))


def clause_words(text: Column) -> Column:
    """The words of a text in lower case, digits as 0, with ``STOP`` after each clause."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"[\p{Nd}]+(?:[,.:][\p{Nd}]+)*", "0")
    t = F.regexp_replace(t, r"\s*[\n\r/]\s*", f" {STOP} ")
    t = F.regexp_replace(t, r"[.,;!?।॥…]+(?=[\s)\]\"'”’]|$)", f" {STOP} ")
    t = F.regexp_replace(t, r"[\[\]()\"“”]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def ending_statistics(words: DataFrame) -> DataFrame:
    """prev, word, goes_on, stops, ends: how often a pair of words is followed by what.

    ``words``: an array without stops at its end.
    """
    n = F.size("words")
    shifted = F.arrays_zip(
        F.concat(F.array(F.lit(STOP)), F.slice("words", F.lit(1), n - 1)).alias("prev"),
        F.col("words").alias("word"),
        F.concat(F.slice("words", F.lit(2), n - 1), F.array(F.lit(END))).alias("next"),
    )
    return (
        words.where(n > 0)
        .select(F.inline(shifted))
        .toDF("prev", "word", "next")
        .where(F.col("word") != STOP)
        .groupBy(F.when(F.col("prev") == STOP, "").otherwise(F.col("prev")).alias("prev"), "word")
        .agg(F.count_if(~F.col("next").isin(STOP, END)).alias("goes_on"), F.count_if(F.col("next") == STOP).alias("stops"), F.count_if(F.col("next") == END).alias("ends"))
    )


def flag_truncated(
    docs: DataFrame,
    scratch: Scratch,
    band: int = 40,
    fdr: float = 0.01,
    loose: float = 0.5,
    strict: float = 0.04,
) -> DataFrame:
    """doc_id, source, n_chars, truncated, reason for every document.

    ``docs``: doc_id, source, text. Lengths are those of the whole text in code points. An ending is
    judged by how often its last two words (its last word where the pair is new) stop a clause or a
    text elsewhere in the corpus, rather than go on or be the beginning of a longer word: ``finish``,
    the text's own ending left out. At a significant length
    a text without closing punctuation is cut if ``finish`` is under ``loose``, or if the text ends in
    white space; elsewhere only if it is under ``strict`` or the last word occurs nowhere else. A
    broken character at the end or an unclosed bracket in the last sentence is a cut anywhere. Dots of
    omission are judged by the words before them. ``reason`` tells which of these it was.

    Defined cases: null, empty and blank texts are not truncated; a null source is a source of its
    own; a row without a doc_id is not truncated; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    bare = F.rtrim("text", F.lit(BLANKS))
    body = F.rtrim(F.regexp_replace(bare, r"(?:\.{2,}|…)$", ""), F.lit(BLANKS))
    # The sentence the text breaks off in, however long.
    sentence = F.regexp_replace(bare, r"(?s)^.*(?:[.!?।]\s|\n)", "")
    dotted = bare.rlike(r"(?:\.\.|…)$")
    words = clause_words(body)
    shown = (
        base.where(F.length(bare) > 0)
        .select(
            "doc_id",
            "source",
            F.length("text").alias("n_chars"),
            words.alias("words"),
            (F.length(bare) < F.length("text")).alias("spaced"),
            bare.endswith("\ufffd").alias("broken"),
            sentence.rlike(r"[\[(][^\])]*$").alias("unclosed"),
            (F.right(bare, F.lit(1)).rlike(r"[.!?।॥)\]\"'”’]") & ~dotted).alias("closed"),
        )
        .withColumn("stopped", F.try_element_at("words", F.lit(-1)) == STOP)
        .withColumn("words", F.when(F.col("stopped"), F.slice("words", F.lit(1), F.size("words") - 1)).otherwise(F.col("words")))
    )
    # The words are made once, and read for the endings and for the statistics.
    shown, _ = scratch.cut(shown)
    word = F.try_element_at("words", F.lit(-1))
    prev = F.try_element_at("words", F.lit(-2))
    tails = shown.select("doc_id", "source", "n_chars", "spaced", "broken", "unclosed", "closed", F.when(word != STOP, word).alias("word"), prev.alias("prev"))
    tails = tails.withColumn("prev", F.when(F.col("prev").isNull() | (F.col("prev") == STOP), "").otherwise(F.col("prev")))
    tails, _ = scratch.cut(tails)
    open_ends = tails.where(~F.col("closed"))
    stats, _ = scratch.cut(ending_statistics(shown.select("words")))
    asked = open_ends.select("word").where(F.col("word").isNotNull()).distinct()
    # A longer word that often follows where the text breaks off speaks for a cut inside it. It is looked
    # up under its beginnings of those lengths that the last words have, of any length.
    lengths = asked.agg(F.collect_set(F.length("word")).alias("lengths"))
    longer = (
        stats.where(F.length("word") > 1)
        .crossJoin(F.broadcast(lengths))
        .select(
            "prev",
            F.explode(F.transform(F.filter("lengths", lambda k: k < F.length("word")), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("word"),
            F.lit(0).alias("goes_on"),
            F.lit(0).alias("stops"),
            F.lit(0).alias("ends"),
            (F.col("goes_on") + F.col("stops") + F.col("ends")).alias("longer"),
        )
    )
    counts = ("goes_on", "stops", "ends", "longer")
    known = (
        stats.withColumn("longer", F.lit(0))
        .unionByName(longer)
        .join(asked, "word", "left_semi")
        .groupBy("prev", "word")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    singles = known.groupBy("word").agg(*[F.sum(c).alias(f"{c}_1") for c in counts])
    rate = lambda s: (F.col(f"stops{s}") + F.col(f"ends{s}") - 1) / F.nullif(
        F.col(f"goes_on{s}") + F.col(f"stops{s}") + F.col(f"ends{s}") + F.col(f"longer{s}") - 1, F.lit(0)
    )
    judged = open_ends.join(known, ["prev", "word"], "left").join(singles, "word", "left").withColumn("finish", F.coalesce(rate(""), rate("_1")))
    limits = length_hazards(tails.select("source", "n_chars"), band, fdr).where("significant").select("source", "n_chars", F.lit(True).alias("at_limit"))
    at_limit = F.coalesce("at_limit", F.lit(False))
    reason = (
        F.when(F.col("broken"), "broken character")
        .when(F.col("unclosed"), "unclosed bracket")
        .when(at_limit & (F.col("spaced") | F.col("finish").isNull() | (F.col("finish") < loose)), "incomplete at a length limit")
        .when(F.col("finish").isNull(), "cut inside a word")
        .when(F.col("finish") < strict, "cut inside a sentence")
    )
    open_found = judged.join(limits, ["source", "n_chars"], "left").select("doc_id", reason.alias("reason"))
    spaced_found = (
        tails.where(F.col("closed") & (F.col("spaced") | F.col("unclosed")))
        .join(limits, ["source", "n_chars"], "left")
        .where(F.col("at_limit") | F.col("unclosed"))
        .select("doc_id", F.lit("incomplete at a length limit").alias("reason"))
    )
    found = open_found.where(F.col("reason").isNotNull()).unionByName(spaced_found)
    return base.select("doc_id", "source", F.length("text").alias("n_chars")).join(found, "doc_id", "left").select(
        "doc_id", "source", "n_chars", F.col("reason").isNotNull().alias("truncated"), "reason"
    )


def truncation_rates(flags: DataFrame) -> DataFrame:
    """The number and share of cut texts per source."""
    return flags.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("truncated").alias("n_cut"), F.avg(F.col("truncated").cast("int")).alias("share_cut"))
