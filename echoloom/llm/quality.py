"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes for good (1) or bad (-1) text or abstains (0). Expectation-maximisation over the counts of vote patterns
(3 to the power of the number of rules at most) estimates the share of good texts and, for each rule, how often its votes
are wrong on good texts and right on bad ones; a document's posterior probability of being good decides. A rule whose
objections come with no others, as that of shortness, loses its say; one that others confirm gains it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, free, table

SYMBOLS = "#*$%&|<>"
#: A word with one of these, as a pattern.
MARKED = r"[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>][^\x20\x09-\x0D]*+"
#: Words of a window that counts as repeated.
WINDOW = 5
#: Words of a span in which different words are counted: their share of a whole text falls with its length.
SPAN = 4096
#: Rounds of expectation-maximisation; votes that the values at the start count for; posterior probability from which a text is kept.
ROUNDS, START_VOTES, KEEP = 20, 5.0, 0.5
#: At the start: share of good texts, of bad votes among a rule's votes on good texts, and among those on bad texts.
PRIOR, WRONG, RIGHT = 0.8, 0.01, 0.3
#: Rules by name: (good where, bad where) over the columns of features(); a condition that is null is false.
RULES = {
    "symbols": ("n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    "letters": ("n_letters >= 0.94 * word_chars", "n_letters < 0.88 * word_chars"),
    "marked_words": ("false", "n_marked > 0.2 * n_words"),
    "repeated_words": ("n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    "repeated_lines": ("n_words >= 50 and n_dup_lines = 0", "n_dup_lines > 2 and n_dup_lines > 0.02 * n_words"),
    "capitals": ("n_capitals <= 0.1 * word_chars", "n_capitals > 0.4 * word_chars"),
    "exclamations": ("n_exclamations <= 0.05 * n_words", "n_exclamations > 0.3 * n_words"),
    "vocabulary": ("n_words >= 50 and n_spread >= 0.4 * n_words", "n_words >= 50 and n_spread < 0.2 * n_words"),
    "word_length": ("word_chars >= 3.5 * n_words and word_chars <= 7 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "length": ("n_words >= 100", "n_words < 20"),
}


#: Columns that this module adds.
OWN = frozenset("n_words word_chars n_symbols n_dup_lines n_repeat_words n_capitals n_exclamations n_letters n_marked n_different n_spread base_failed votes quality kept _words _different _hashes _lines _model".split())


def split_words(text: Column) -> Column:
    """The runs of a text without ASCII white space; none of null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5), " "), "")


def _bind(value: Column, body) -> Column:
    """body(value) with value found once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(places: Column) -> Column:
    """Words that windows starting at these ascending places cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"))
    return F.aggregate(places, zero, step, lambda s: s["n"])


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that come twice or more. hashes has one 64-bit hash for each window, in order.

    Most texts repeat no window, which a hash set tells; only the others are sorted.
    """

    def places(ordered: Column) -> Column:
        same = lambda x, k: (F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_covered(_bind(ordered, places)))


def spread(words: Column, different: Column) -> Column:
    """Different words of each span of SPAN words, summed over the whole text."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(SPAN))
    spans = F.aggregate(starts, F.lit(0), lambda s, i: s + F.size(F.array_distinct(F.slice(words, i, SPAN))))
    return F.when(F.size(words) > SPAN, spans).otherwise(F.size(different))


def features(docs: DataFrame) -> DataFrame:
    """docs with (in place of columns called so) n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the other rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_words", split_words(F.col("text")))
    window = lambda i: F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(WINDOW)))
    some = F.size("_words") >= WINDOW
    rows = rows.withColumn("_hashes", F.when(some, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_different", F.array_distinct("_words"))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    long = lambda c: c.cast("long")
    found = rows.select(
        *(c for c in docs.columns if c.lower() not in OWN),
        long(F.size("_words")).alias("n_words"),
        long(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("_words"), F.col("_hashes"))).alias("n_repeat_words"),
        long(F.char_length(F.regexp_replace(text, r"\P{Lu}+", ""))).alias("n_capitals"),
        long(F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_exclamations"),
        long(F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))).alias("n_letters"),
        long(F.regexp_count(text, F.lit(MARKED))).alias("n_marked"),
        long(F.size("_different")).alias("n_different"),
        long(spread(F.col("_words"), F.col("_different"))).alias("n_spread"),
    )
    return found


def votes() -> Column:
    """A vote for each rule, in order; all abstain on a text without words."""
    return F.array(*(F.expr(f"case when n_words = 0 then 0 when {good} then 1 when {bad} then -1 else 0 end") for good, bad in RULES.values()))


def start(rules: int = len(RULES)) -> Column:
    """What is believed before any vote: wrong and right, the shares of bad votes on good and on bad texts, and the prior."""
    same = lambda x: F.array(*[F.lit(x)] * rules)
    return F.struct(same(WRONG).alias("wrong"), same(RIGHT).alias("right"), F.lit(PRIOR).alias("prior"))


def posterior(model: Column, given: Column) -> Column:
    """Probability of a good text. Where every rule abstains it is the prior, the estimated share of good texts."""
    rules = F.zip_with(model["wrong"], model["right"], lambda w, r: F.struct(w.alias("w"), r.alias("r")))
    odds = F.zip_with(given, rules, lambda v, m: F.when(v == -1, F.log(m["w"] / m["r"])).when(v == 1, F.log((1 - m["w"]) / (1 - m["r"]))).otherwise(0.0))
    return 1 / (1 + F.exp(-F.aggregate(odds, F.log(model["prior"] / (1 - model["prior"])), lambda s, x: s + x)))


def fit(patterns: DataFrame, rounds: int = ROUNDS, rules: int = len(RULES)) -> DataFrame:
    """One row, model: struct(wrong, right, prior) of the rules in order, from rows (votes, n), one for each pattern.

    Every value is a share of votes, or of texts, in which the start counts for START_VOTES; with no rows it stays.
    """
    patterns = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))  # at most 3 ** rules

    def total(rows: Column, part) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + part(x))

    def maximise(rows: Column) -> Column:
        def share(weight, first: float):
            def of(j: Column) -> Column:
                vote = lambda x: F.get(x["votes"], j)
                bad = total(rows, lambda x: F.when(vote(x) == -1, weight(x)).otherwise(0.0))
                cast = total(rows, lambda x: F.when(vote(x) != 0, weight(x)).otherwise(0.0))
                return (bad + START_VOTES * first) / (cast + START_VOTES)

            return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), of)

        good = total(rows, lambda x: x["n"] * x["p"])
        prior = (good + START_VOTES * PRIOR) / (total(rows, lambda x: x["n"]) + START_VOTES)
        return F.struct(share(lambda x: x["n"] * x["p"], WRONG).alias("wrong"), share(lambda x: x["n"] * (1 - x["p"]), RIGHT).alias("right"), prior.alias("prior"))

    def round_(model: Column, _: Column) -> Column:
        expected = F.transform("patterns", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(model, x["votes"]).alias("p")))
        return _bind(expected, maximise)

    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start(rules), round_).alias("model"))


def assess(docs: DataFrame, keep: float = KEEP, columns: Sequence[str] | None = None) -> DataFrame:
    """docs with the counts of features(), base_failed, quality (the posterior probability of a good text) and kept.

    base_failed: under 10 words, or over 20 in 100 words in repeated windows; such a text is never kept. A null or empty
    text has no words and fails. A text on which every rule abstains has the estimated share of good texts as its quality.
    Null doc_ids, repeated rows and further columns stay; an empty table gives no rows.
    columns names those of docs that the result has (by default all). Rows are counted once and written to the shared scratch folder; only pattern counts are shuffled.
    """
    wanted = [c for c in (docs.columns if columns is None else columns) if c.lower() not in OWN]
    rows = features(docs).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("votes", votes())
    rows = rows.select(*wanted, *(c for c in rows.columns if c in OWN))
    rows = Scratch(docs.sparkSession).save(rows, "votes", compression="zstd")
    model = fit(rows.groupBy("votes").agg(F.count("*").alias("n")))
    rows = rows.withColumn("_model", model.scalar())
    rows = rows.withColumn("quality", posterior(F.col("_model"), F.col("votes"))).drop("_model")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def filter_quality(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with their own columns alone."""
    box = free("document", docs)
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(box))
    return assess(rows, keep, [box]).filter("kept").select(f"{box}.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assess(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
