"""Toxicity: gradient-boosted trees over dense lexical features, calibrated by isotonic regression.

Fitting uses a sample of at most `sample` labelled rows (SAMPLE by default); scoring covers every row
in one pass without a shuffle. Inputs of a score come from the text alone.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_text, text_groups

#: Labelled rows that a model is fitted on at most, chosen by a hash of their id.
SAMPLE = 20_000
#: Standard errors by which the log odds of a lexicon key exceed zero.
SURE = 3.3
PREFIX = 4
NEAR = 5

# Insults that count as lexicon words before any are learned.
SEEDS = frozenset("clown disgusting dumb idiot imbecile loser moron pathetic scum stupid trash worthless".split())
# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner euch euer ihr ti tus usted ustedes vosotros".split())
# Signs that stand for letters in obfuscated words.
SIGNS = str.maketrans("013457@$!|", "oieastasil")

_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = ("log_tokens", "lexicon_density", "lexicon_hits", "prefix_density", "prefix_hits", "obfuscated_hits", "second_person", "near_second_person", "capitals", "exclamations", "symbols", "obfuscation", "mean_weight", "max_weight")


def keys_of(token: str) -> tuple[str, ...]:
    """Lexicon keys of a token split at white space: each run of letters, and its first letters."""
    words = _LETTERS.findall(token.lower())
    return (*words, *{w[:PREFIX] + "-" for w in words if len(w) > PREFIX})


#: Tokens that a task remembers, about 150 bytes each, before it starts anew.
REMEMBERED = 250_000


class _Tokens(dict):
    """token -> its place in rows, the different ones of: lexicon word, prefix, obfuscated hit, second person,
    capitals, obfuscated, weight. Most tokens are plain: the row of zeros, place 0."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.rows, self.places = [(0.0,) * 7], {(0.0,) * 7: 0}
        self.table = np.array(self.rows)

    def __missing__(self, token: str) -> int:
        lexicon, words = self.lexicon, _LETTERS.findall(token.lower())
        hit = [lexicon[w] for w in words if w in lexicon]
        pre = [lexicon[w[:PREFIX] + "-"] for w in words if len(w) > PREFIX and w[:PREFIX] + "-" in lexicon]
        core = token.strip(".,;:!?\"'()[]|")
        mixed = len(core) > 2 and not core.isalpha() and any(c.isalpha() for c in core)
        plain = "".join(c for c in core.lower().translate(SIGNS) if c.isalpha()) if mixed else ""
        hidden = bool(plain) and not hit and plain in lexicon
        row = (float(bool(hit)), float(bool(pre)), float(hidden), float(any(w in SECOND_PERSON for w in words)), float(len(core) > 2 and core.isupper()), float(mixed), max([*hit, *pre, lexicon.get(plain, 0.0) if hidden else 0.0], default=0.0))
        place = self.places.setdefault(row, len(self.rows))  # as many as weights of the lexicon, times 64 at most
        if place == len(self.rows):
            self.rows.append(row)
        self[token] = place
        return place


def features(text: str | None, tokens: _Tokens) -> list[float]:
    """The dense features of one whole text; null and empty texts give zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    if len(tokens) > REMEMBERED:
        tokens.clear()
    place = np.fromiter(map(tokens.__getitem__, words), np.int64, n)
    if len(tokens.table) < len(tokens.rows):
        tokens.table = np.array(tokens.rows)
    at = np.flatnonzero(place)
    t = tokens.table[place[at]]
    total = t.sum(axis=0)
    bad = (t[:, 0] + t[:, 1] + t[:, 2]) > 0
    near = 0
    if total[3] and bad.any():
        you = np.zeros(n + 1)
        you[at + 1] = t[:, 3]
        you = np.cumsum(you)
        bad_at = at[bad]
        near = int((you[np.minimum(bad_at + NEAR + 1, n)] - you[np.maximum(bad_at - NEAR, 0)] > 0).sum())
    marks, signs = sum(map(text.count, "!?")), sum(map(text.count, "%$#&*@"))
    return [math.log1p(n), total[0] / n, math.log1p(total[0]), total[1] / n, math.log1p(total[1]), total[2] / n, total[3] / n, near / n, total[4] / n, marks / n, signs / n, total[5] / n, total[6] / n, t[:, 6].max(initial=0.0)]


@dataclass
class Trees:
    """Boosted trees of depth 3 on binned features, for the logistic loss."""

    rounds: int = 80
    rate: float = 0.15
    depth: int = 3
    bins: int = 48
    least: float = 2.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = math.log(p / (1 - p)), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        # densities are zero nearly everywhere: the cut just above the smallest value is always there
        cuts = [np.unique(np.append(c, (np.sort(np.unique(x[:, j]))[:2]).mean())) for j, c in enumerate(cuts)]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                best = [(0.0, -1, 0.0, 0)] * (1 << level)
                for j, c in enumerate(cuts):
                    size = len(c) + 1
                    at = node * size + b[:, j]
                    gs = np.bincount(at, g, (1 << level) * size).reshape(-1, size).cumsum(axis=1)
                    hs = np.bincount(at, h, (1 << level) * size).reshape(-1, size).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    for i, k in enumerate(gain[:, :-1].argmax(axis=1) if size > 1 else []):
                        if gain[i, k] > best[i][0] + 1e-9:
                            best[i] = (gain[i, k], j, c[k], k)
                splits.append([(j, cut) for _, j, cut, _ in best])
                j, k = np.array([s[1] for s in best])[node], np.array([s[3] for s in best])[node]
                node = 2 * node + ((j >= 0) & (b[np.arange(len(y)), np.maximum(j, 0)] > k))
            leaf = -self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + 1)
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in splits:
                j, cut = np.array([s[0] for s in level])[node], np.array([s[1] for s in level])[node]
                node = 2 * node + ((j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > cut))
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (margins, values) of a non-decreasing step curve, joined by lines."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([c / n for _, n, c in blocks]), np.array([s / n for s, n, _ in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0) if len(self.knots[0]) else np.zeros(len(x))


def _lexicon(rows: list, pos: int, neg: int, a: str, n: str) -> dict[str, float]:
    """Keys that mark the positive texts, with their log odds. rows: key, counts in all and positive texts."""
    found, most = [], {}
    for r in rows:
        p, q = r[a], r[n] - r[a]
        odds = math.log((p + 0.5) / (pos + 1)) - math.log((q + 0.5) / (neg + 1))
        z = odds / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        if z > SURE and p > 4 * q:
            found.append((z, r["key"], odds, p))
        if r["key"][-1] != "-":
            most[r["key"][:PREFIX] + "-"] = max(p, most.get(r["key"][:PREFIX] + "-", 0))
    # a prefix adds nothing where one word makes up most of it
    found = [x for x in found if x[1][-1] != "-" or most.get(x[1], 0) < 0.8 * x[3]]
    return {w: 3.0 for w in SEEDS} | {k: odds for _, k, odds, _ in sorted(found, reverse=True)}


def _feature_rows(df: DataFrame, lexicons: list[dict[str, float]], which: str, keep: list[str]) -> DataFrame:
    """keep and x: the features by lexicons[row[which]]."""

    def run(batches):
        tokens = [_Tokens(x) for x in lexicons]
        for b in text_groups(batches):
            x = [features(t, tokens[k]) for t, k in zip(b.column("text").to_pylist(), b.column(which).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", x array<double>")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits lexicon, trees and calibration on at most `sample` labelled rows.

    Rows whose crc32(id) mod 5 is 0 are held out. Labels of ids without a document, null ids and null
    labels are not used; of several labels of an id the largest counts, of several texts the greatest. Equal texts count once. Half
    of the sample serves the other half's lexicon and calibration margins, so neither sees its own
    labels. Without rows of both classes every score is 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows of 16 bytes are broadcast
    text = small_text(docs[text_col]).alias("text")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text).join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).groupBy("hash").agg(F.max(F.struct("y", "id", "text")).alias("r")).select("r.y", "r.text", F.pmod("hash", F.lit(2)).cast("int").alias("half"))
    rows = materialize(rows, "labelled")
    sizes = {(r["half"], r["y"]): r["count"] for r in rows.groupBy("half", "y").count().collect()}
    pos, neg = ([sizes.get((k, y), 0) for k in (0, 1)] for y in (1, 0))
    if not sum(pos) or not sum(neg):
        return Model({}, Trees(), (np.zeros(0), np.zeros(0)))

    def keys(batches):
        for b in text_groups(batches):
            out: list[tuple] = []
            for t, y, k in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("half").to_pylist()):
                out += [(w, y, k) for w in {w for token in set(t.split()) for w in keys_of(token)}]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int32(), pa.int32()))], names=["key", "y", "half"])

    counts = rows.mapInArrow(keys, "key string, y int, half int").groupBy("key").agg(*[F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(n) for n, e in (("n0", "1 - half"), ("n1", "half"), ("a0", "y * (1 - half)"), ("a1", "y * half"))])
    counts = counts.withColumn("n", F.col("n0") + F.col("n1")).withColumn("a", F.col("a0") + F.col("a1")).where("a >= 3 and 2 * a > n")
    top = counts.orderBy("key").collect()  # keys of three labelled texts or more, so the sample bounds them
    lexicons = [_lexicon(top, pos[1 - k], neg[1 - k], f"a{1 - k}", f"n{1 - k}") for k in (0, 1)]
    got = _feature_rows(rows, lexicons, "half", ["y", "half"]).collect()  # `sample` rows at most
    x, y, half = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float), np.array([r["half"] for r in got])
    order = np.lexsort((*x.T, y, half))
    x, y, half = x[order], y[order], half[order]
    margins = np.zeros(len(y))
    for k in (0, 1):
        seen = half != k
        margins[half == k] = Trees().fit(x[seen], y[seen]).margin(x[half == k]) if seen.any() else 0.0
    return Model(_lexicon(top, sum(pos), sum(neg), "a", "n"), Trees().fit(x, y), isotonic(margins, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; null text counts as empty.

    Repeated rows stay, a null id is not held out, an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), small_text(docs[text_col]).alias("text"))

    def run(batches):
        tokens = _Tokens(model.lexicon)
        for b in text_groups(batches):
            x = np.array([features(t, tokens) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        tokens = _Tokens(model.lexicon)
        for b in text_groups(batches, column=b_text):
            x = np.array([features(t, tokens) for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) < threshold))

    b_text = names[at]
    return docs.mapInArrow(run, docs.schema)
