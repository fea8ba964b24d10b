"""Toxicity scores against a plain version of sample, lexicon, features, trees and calibration."""

import math
import re
import zlib

import numpy as np
import pandas as pd

from echoloom.llm import boosting, registry, toxicity

NAMES = toxicity.FEATURES


def plain_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def plain_features(text, words, stems):
    found = plain_words(text)
    n = max(1, len(found))
    known = [w in words or w in toxicity.INSULTS for w in found]
    you = [i for i, w in enumerate(found) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i, k in enumerate(known) if k)
    mixed = toxicity._MIXED.findall(text.lower()) + toxicity._SPACED.findall(text.lower())
    plain = ["".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}.get(c, "" if c in "*#._- " else c) for c in w) for w in mixed]
    letters = sum(len(c.encode()) for c in text if c.isascii() and c.isalpha() or not c.isascii())
    points = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    return {
        "insults": 100 * sum(w in toxicity.INSULTS for w in found) / n, "lexicon": 100 * sum(w in words for w in found) / n, "kinds": len({w for w, k in zip(found, known) if k}),
        "weight": 100 * sum(words.get(w, toxicity.ODDS) for w, k in zip(found, known) if k) / n, "stems": 100 * sum(w[:5] in stems for w in found) / n, "near": 100 * near / n, "you": 100 * len(you) / n,
        "hidden": 100 * sum(w in words or w in toxicity.INSULTS for w in plain) / n, "mixed": 100 * len(plain) / n, "capitals": sum("A" <= c <= "Z" for c in text) / max(1, letters),
        "points": points / max(1, len(text.encode())), "exclamations": text.count("!") / n, "length": math.log(1 + len(found)),
    }


def plain_lexicon(rows):
    """Words and beginnings that toxic rows hold far more often, of (text, toxic)."""
    toxic, clean = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    share, out = (toxic + 0.5) / (toxic + clean + 1), []
    for cut in (lambda w: w if len(w) > 2 else None, lambda w: w[:5] if len(w) > 5 else None):
        counts = {}
        for text, label in rows:
            for entry in {cut(w) for w in plain_words(text)} - {None}:
                counts.setdefault(entry, [0, 0])[label] += 1
        odds = {e: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for e, (b, a) in counts.items() if a >= 3}
        ratio = {e: 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)) for e, (b, a) in counts.items() if e in odds}
        out.append({e: o for e, o in odds.items() if o >= 2.5 and ratio[e] >= 15})
    return out


def plain_boost(x, y):
    """Newton steps on log-loss, every node split by trying every cut of every feature."""
    n = len(y)
    cuts = [sorted({sorted(x[:, j])[math.floor(q * (n - 1) + 1e-9)] for q in np.linspace(0, 1, 33)[1:-1]}) for j in range(x.shape[1])]
    start = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    trees, margin = [], np.full(n, start)

    def grow(rows, depth, g, h):
        if depth == 3:
            return 0.2 * g[rows].sum() / (h[rows].sum() + 1)
        best, found = 1e-9, None
        for j, values in enumerate(cuts):
            top = max(((gain(rows & (x[:, j] <= c), rows & (x[:, j] > c), g, h), -k) for k, c in enumerate(values)), default=(0, 0))
            if top[0] > best:
                best, found = top[0] + 1e-9, (j, values[-top[1]])
        left = rows & (x[:, found[0]] <= found[1]) if found else rows
        return found, grow(left, depth + 1, g, h), grow(rows & ~left, depth + 1, g, h)

    def gain(a, b, g, h):
        if h[a].sum() < 2 or h[b].sum() < 2:
            return 0
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        return score(a) + score(b) - score(a | b)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[1] if tree[0] is None or row[tree[0][0]] <= tree[0][1] else tree[2]
        return tree

    for _ in range(60):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.full(n, True), 0, y - p, p * (1 - p)))
        margin = margin + np.array([value(trees[-1], row) for row in x])
    return lambda rows: np.array([start + sum(value(t, row) for t in trees) for row in rows])


def plain_isotonic(score, y):
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order]
    sums = np.concatenate([[0], np.cumsum(v)])
    fit = [max(min((sums[b + 1] - sums[a]) / (b + 1 - a) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    runs = np.concatenate([[0], np.flatnonzero(np.abs(np.diff(fit)) > 1e-12) + 1, [len(v)]])
    return [s[a:b].mean() for a, b in zip(runs, runs[1:])], [v[a:b].mean() for a, b in zip(runs, runs[1:])]


def test_op6_plain_version(spark, sf):
    docs, labels = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.dropna(subset=["toxic"]).groupby("doc_id").toxic.max()
    rows = [(zlib.crc32(f"{i}/fold".encode()) % 3, int(known[i]), t or "") for i, t in zip(docs.doc_id, docs.text) if i in known.index and zlib.crc32(str(i).encode()) % 3 != 1]
    lexicons = {f: plain_lexicon([(t, y) for g, y, t in rows if g != f]) for f in (0, 1, 2, None)}
    table = sorted((f, y, list(plain_features(t, *lexicons[f]).values())) for f, y, t in rows)
    x, y, fold = np.array([r[2] for r in table]), np.array([r[1] for r in table], float), np.array([r[0] for r in table])
    out = np.zeros(len(y))
    for f in range(3):
        out[fold == f] = plain_boost(x[fold != f], y[fold != f])(x[fold == f])
    knots = plain_isotonic(out, y)
    margin = plain_boost(x, y)(np.array([list(plain_features(t or "", *lexicons[None]).values()) for t in docs.text]))
    want = dict(zip(docs.doc_id, 0.99 * np.interp(margin, *knots) + 0.01 / (1 + np.exp(-margin))))
    found = registry.QUERIES["op6_toxicity"](spark, sf).toPandas()
    np.testing.assert_allclose(found.score, [want[i] for i in found.doc_id], atol=1e-9)
    assert (found.predicted == (found.score >= 0.7)).all() and [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id] == list(found.held_out)


def test_boosting_plain_version():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(150, 4)), 1)
    y = (rng.random(150) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] ** 2))).astype(float)
    np.testing.assert_allclose(boosting.boost(x, y).margin(x), plain_boost(x, y)(x), atol=1e-8)
    knots = boosting.isotonic(x[:, 0], y)
    np.testing.assert_allclose(np.array(knots), np.array(plain_isotonic(x[:, 0], y)), atol=1e-12)


def test_op6_sample_has_one_row_an_id(spark):
    """An id that a third of the rows share gives one row, whatever its texts; all ids of the bound are there."""
    docs = spark.range(3000).selectExpr("if(id < 1000, 5, id) as doc_id", "if(id % 7 = 0, null, concat('text ', id % 50)) as text").repartition(6)
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    for most in (300, 20_000):
        sample = toxicity.training_sample(docs, labels, most).toPandas()
        ids = [i for i in [5, *range(1000, 3000)] if zlib.crc32(str(i).encode()) % 3 != 1]
        assert len(sample) <= most and (most == 300 or len(sample) == len(ids))
    again = toxicity.training_sample(docs.repartition(3), labels).toPandas()
    order = lambda f: sorted(map(str, f.itertuples(index=False)))
    assert order(again) == order(sample)
