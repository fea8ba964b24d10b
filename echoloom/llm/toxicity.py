"""Toxicity: boosted trees over dense text features with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, boost, isotonic
from .common import Scratch, free, map_arrow, table

#: Labelled documents that the model is fitted to at most (those with the smallest hashed ids), folds that hold out parts
#: of them for calibration, score from which a text counts as toxic.
SAMPLE, FOLDS, CUT = 20_000, 3, 0.7
#: Learned lexicon, part of the classifier that is fitted to the bounded sample: entries at most, words and beginnings each
#: (chosen among the four times as many that most toxic documents of the sample hold), toxic documents an entry needs, least log-odds and least likelihood ratio of it.
ENTRIES, DOCUMENTS, ODDS, RATIO = 4000, 3, 2.5, 15.0
#: Letters of a word's beginning that are looked up as well, and words around a second-person word that count as near it.
STEM, NEAR = 5, 5
#: Common insults, known before any label is seen.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool loser losers scum trash garbage filth vermin pathetic worthless disgusting clown imbecile jerk coward creep pig rat dumm dummkopf trottel abschaum arschloch ekelhaft idiota imbécil estúpido basura escoria inútil asqueroso imbécile stupide crétin connard ordure débile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*!#|+._-]+[^\W\d_]+[^\s.,;:!?]*|[@$][^\W\d_]{2,}")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"} | dict.fromkeys("*#._- "))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_POINTS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FEATURES = ("insults", "lexicon", "lexicon_kinds", "weight", "stems", "near_you", "you", "hidden", "mixed", "capitals", "punctuation", "exclamations", "length")


@dataclass
class Lexicon:
    """Learned words and word beginnings with their log-odds of a toxic document."""

    words: dict[str, float]
    stems: dict[str, float]


def text_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Densities in a whole text; an empty or null text has zeros."""
    text = text or ""
    raw = text.encode()
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    insults = learned = kinds = near = you = 0
    weight = 0.0
    hits: list[int] = []
    if not (lexicon.words.keys().isdisjoint(words) and INSULTS.isdisjoint(words)):
        known = lexicon.words
        hits = [i for i, w in enumerate(words) if w in known or w in INSULTS]
        learned = sum(words[i] in known for i in hits)
        insults = sum(words[i] in INSULTS for i in hits)
        kinds = len({words[i] for i in hits})
        weight = sum(known.get(words[i], ODDS) for i in hits)
    if not SECOND_PERSON.isdisjoint(words):
        at = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        you = len(at)
        if hits:
            places = np.searchsorted(at, hits)
            near = sum(min(abs(h - at[k]) for k in (max(0, p - 1), min(len(at) - 1, p))) <= NEAR for h, p in zip(hits, places.tolist()))
    stems = len([1 for w in words if w[:STEM] in lexicon.stems]) if lexicon.stems else 0
    mixed = _MIXED.findall(low) if re.search(r"[0-9@$*!#|+_-]", low) else []
    spaced = _SPACED.findall(low)
    plain = [w.translate(_PLAIN) for w in mixed] + [w.translate(_PLAIN) for w in spaced]
    hidden = sum(w in lexicon.words or w in INSULTS for w in plain)
    size = max(1, len(raw))
    letters = max(1, size - len(raw.translate(None, _LETTERS)))
    capitals, points = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _POINTS))
    return [100 * insults / n, 100 * learned / n, float(kinds), 100 * weight / n, 100 * stems / n, 100 * near / n, 100 * you / n, 100 * hidden / n, 100 * len(plain) / n, capitals / letters, points / size, raw.count(b"!") / n, float(np.log1p(len(words)))]


def _fold(doc_id: str) -> str:
    return f"cast(pmod(crc32(cast(concat({doc_id}, '/fold') as binary)), {FOLDS}) as int)"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic, fold) of at most `most` labelled documents that aren't held out, those of the smallest hashed ids.

    The ids are a bounded table, so documents are picked where they lie and only their texts are shuffled. Of documents that
    share an id the text of the smallest hash is taken (ties: the smaller text, null first), so that no id has two rows.
    """
    rows = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(most).withColumn("fold", F.expr(_fold("_id")))
    found = docs.join(F.broadcast(rows), docs["doc_id"] == rows["_id"]).select("_id", "toxic", "fold", "text")
    first = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))["text"]
    return found.groupBy("_id", "toxic", "fold").agg(first.alias("text")).select("text", "toxic", "fold")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word ('w:') and word beginning ('s:'), by fold and label."""
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic, fold in zip(batch.column("text"), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()):
            words = {w for w in _WORD.findall((text.as_py() or "").lower()) if len(w) > 2}
            for entry in {"w:" + w for w in words} | {"s:" + w[:STEM] for w in words if len(w) > STEM}:
                counts[entry, fold, toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["entry", "fold", "toxic", "n"])


def _lexicon(rows: list, totals: dict, skip: int | None) -> Lexicon:
    """Entries that tell toxic from other documents, from the counts of all folds but one."""
    toxic = sum(n for (f, t), n in totals.items() if t == 1 and f != skip)
    clean = sum(n for (f, t), n in totals.items() if t == 0 and f != skip)
    found: dict[str, dict[str, float]] = {"w": {}, "s": {}}
    share = (toxic + 0.5) / (toxic + clean + 1)
    for entry, by_fold in rows:
        a = sum(x["a"] for x in by_fold if x["fold"] != skip)
        b = sum(x["b"] for x in by_fold if x["fold"] != skip)
        if a < DOCUMENTS:
            continue
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        ratio = 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if odds >= ODDS and ratio >= RATIO:
            found[entry[0]][entry[2:]] = float(odds)
    best = {k: dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES]) for k, v in found.items()}
    return Lexicon(best["w"], best["s"])


def _features(lexicons: dict[int | None, Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t.as_py(), lexicons.get(f, lexicons[None])) for t, f in zip(batch.column("text"), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold")], ["x", "toxic", "fold"])

    return run


class Model:
    """A fitted scorer: lexicon, trees and the knots of the calibration."""

    def __init__(self, lexicon: Lexicon, trees: Boosted | None, knots: tuple[np.ndarray, np.ndarray], base: float):
        self.lexicon, self.trees, self.knots, self.base = lexicon, trees, knots, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a small share of the trees' own probability keeps the order inside level parts."""
        if self.trees is None:
            return np.full(len(x), self.base)
        margin = self.trees.margin(x)
        return 0.99 * np.interp(margin, *self.knots) + 0.01 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit the scorer to a bounded sample of labels that aren't held out.

    Features of a sampled document come from a lexicon of the other folds, so no document vouches for its own words;
    the calibration is fitted to scores of trees of the other folds. The lexicon holds ENTRIES words and ENTRIES word
    beginnings at most, so what is sent to the tasks is bounded; scoring reads every text whole. With no labels of both kinds every score is the
    share of toxic ones (0 without labels).
    """
    scratch = Scratch(docs.sparkSession)
    sample = scratch.save(training_sample(docs, labels, most), "sample")
    totals = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    kinds = {t for (_, t), n in totals.items() if n}
    if kinds != {0, 1}:
        return Model(Lexicon({}, {}), None, (np.zeros(1), np.zeros(1)), float(1 in kinds))
    a, b = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    counted = map_arrow(sample, _count_words, "entry string, fold int, toxic int, n long").groupBy("entry", "fold").agg(a.alias("a"), b.alias("b"))
    entries = counted.groupBy("entry").agg(F.collect_list(F.struct("fold", "a", "b")).alias("by_fold"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    toxic, clean = (sum(n for (_, t), n in totals.items() if t == k) for k in (1, 0))
    telling = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    entries = entries.filter(F.col("a") >= DOCUMENTS).filter(telling >= ODDS / 2).orderBy(F.desc("a"), "entry").limit(4 * ENTRIES)
    rows = [(r["entry"], r["by_fold"]) for r in entries.collect()]  # bounded by the limit
    lexicons: dict[int | None, Lexicon] = {f: _lexicon(rows, totals, f) for f in [*range(FOLDS), None]}
    found = map_arrow(sample, _features(lexicons), "x array<double>, toxic int, fold int").collect()  # most rows of a few numbers
    scratch.drop("sample")
    order = sorted(found, key=lambda r: (r["fold"], r["toxic"], list(r["x"])))
    x, y, fold = np.array([r["x"] for r in order]), np.array([r["toxic"] for r in order], float), np.array([r["fold"] for r in order])
    out = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            rest = fold != f if len(set(y[fold != f])) == 2 else np.full(len(y), True)
            out[fold == f] = boost(x[rest], y[rest]).margin(x[fold == f])
    return Model(lexicons[None], boost(x, y), isotonic(out, y), float(y.mean()))


def _score(model: Model, columns: list[str], text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py(), model.lexicon) for t in batch.column(text)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(model.scores(x))], [*columns, name])

    return run


def score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The named columns of docs and the score, from 0 to 1, of every row's whole text. No row is shuffled."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    rows = docs.select(*dict.fromkeys([*columns, "text"]))
    return map_arrow(rows, _score(model, columns, "text", name), f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `cut` on) of every document.

    Only texts are scored: labels, language, source and id never are. Null and empty texts are scored as texts without
    words. Null ids and repeated rows stay; of repeated labels the largest counts; labels without a document are unused;
    an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = score(rows, fit(rows, labels), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score below `cut`, with all their columns, whatever they are called."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    name = free("score", docs)
    return score(docs, model, docs.columns, name).filter(F.col(name) < cut).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
