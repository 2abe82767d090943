"""Toxicity classifier regularised by counterfactuals.

A sparse logistic model over the set of a text's words and of their beginnings (compounding languages
build many words on one stem). Labelled texts that mention a group get counterfactual
copies with the mention swapped for every other term of the list, and training penalises the squared change of the
score's logit between a text and its copies, over all features in which they differ. A copy has the features of the rest
of its text and those of the other term, so it is kept as the term and what the rest lacks of all terms' features. So
words that merely name a group can't carry the label, and neutral mentions aren't flagged. `SAMPLE` bounds the labelled
rows that training takes (the first by a hash of their ids, one text an id); of those only hashed word sets go to the
driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import add_columns, small_parts, with_fields

SAMPLE = 8_000
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
BITS = 20
#: Terms that name groups, by language; a parameter of fit(). A term is swapped for those of its own language.
IDENTITY_TERMS = {
    "en": "women men girls boys gay lesbian transgender straight muslim muslims christian christians jewish jews hindu buddhist atheist "
    "black white asian latino african european american mexican chinese indian arab immigrants refugees disabled deaf blind elderly young".split(),
    "de": "frauen männer mädchen buben schwule lesben muslime christen juden hindus atheisten schwarze weiße türken polen araber "
    "flüchtlinge einwanderer behinderte gehörlose blinde alte junge".split(),
    "fr": "femmes hommes filles garçons homosexuels lesbiennes musulmans chrétiens juifs bouddhistes athées noirs blancs asiatiques arabes "
    "africains immigrés réfugiés handicapés sourds aveugles vieux jeunes".split(),
    "es": "mujeres hombres niñas niños homosexuales lesbianas musulmanes cristianos judíos budistas ateos negros blancos asiáticos árabes "
    "africanos gitanos inmigrantes refugiados discapacitados sordos ciegos ancianos jóvenes".split(),
}
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def held_out(id_column: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def word_of(piece: str) -> str:
    return _EDGE.sub("", piece).lower()


PREFIXES = (4, 5, 6, 7)


class Features(dict):
    """Buckets of a piece between blanks: its word, lower-cased and bare of marks at its ends, and the word's beginnings.

    With `held`, only buckets in it, so that most pieces of a text being scored have none.
    """

    def __init__(self, held=None):
        super().__init__()
        self.held = held

    def __missing__(self, piece: str) -> tuple[int, ...]:
        word = word_of(piece)
        made = [bucket(word), *(bucket("^" + word[:n]) for n in PREFIXES if len(word) > n)] if word else []
        out = tuple(made if self.held is None else (k for k in made if k in self.held))
        if len(self) >= 300_000:
            self.clear()
        self[piece] = out
        return out


def feature_set(text: str | None, features: Features) -> list[int]:
    found: set[int] = set()
    found.update(*filter(None, map(features.__getitem__, set((text or "").split()))))
    return sorted(found)


class Swaps:
    """Counterfactual copies of a text: for each term that it mentions, which features of all terms the rest of it lacks.

    With A[o] the sum of the weights that term o adds to the rest, the copy with o in place of t changes the logit by
    A[o] - A[t]. `terms` is a list, or lists by language; `partners` tells which terms stand in for which.
    """

    def __init__(self, terms: Sequence[str] | dict[str, Sequence[str]], features: Features):
        lists = terms if isinstance(terms, dict) else {"": terms}
        language: dict[str, str] = {}
        for name, own in lists.items():
            for t in own:
                language.setdefault(t.lower(), name)
        self.words = list(language)
        names = np.array(list(language.values()), dtype=object)
        self.partners = (names[:, None] == names[None, :]) & ~np.eye(len(names), dtype=bool)
        self.groups = [features[t] for t in self.words]
        self.names = sorted(set().union(*self.groups))
        self.by_bucket = {bucket(t): k for k, t in enumerate(self.words)}

    def of(self, text: str | None, features: Features) -> list[bytes]:
        """Term as two bytes, then a bit for each of `names`."""
        pieces = set((text or "").split())
        mentions: dict[int, list[str]] = {}
        for piece in pieces:
            found = features[piece]
            k = self.by_bucket.get(found[0]) if found else None
            if k is not None and word_of(piece) == self.words[k]:
                mentions.setdefault(k, []).append(piece)
        if not mentions:
            return []
        often = Counter(f for piece in pieces for f in features[piece])
        out = []
        for k, own in sorted(mentions.items()):
            swapped = Counter(f for piece in own for f in features[piece])
            out.append(k.to_bytes(2, "little") + np.packbits([often[f] <= swapped[f] for f in self.names]).tobytes())
        return out


def word_swaps(sets: list[np.ndarray], identity: list[int]) -> tuple[list[tuple[int, ...]], list[int], Counter]:
    """Terms' features, their names and the copies where a term has no feature but its word."""
    groups, names = [(t,) for t in dict.fromkeys(identity)], sorted(set(identity))
    copies: Counter = Counter()
    for s in sets:
        held = set(s.tolist())
        for k, (t,) in enumerate(groups):
            if t in held:
                copies[k.to_bytes(2, "little") + np.packbits([f == t or f not in held for f in names]).tobytes()] += 1
    return groups, names, copies


def train(
    sets: list[np.ndarray], y: np.ndarray, identity: list[int], l1: float = 1.5e-4, ridge: float = 1e-6, penalty: float = 1.0, steps: int = 300,
    swaps: tuple[list[tuple[int, ...]], list[int], Counter] | None = None, partners: np.ndarray | None = None,
) -> tuple[dict[int, float], float]:
    """Adaptive proximal gradient on log loss + L1 + counterfactual penalty. Returns nonzero weights and the bias.

    `swaps`: the terms' features, their names and the copies with their numbers; without it, terms are their words only.
    `partners`: for each term, those that it is swapped for; all others without it.
    """
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return {}, float(np.log((rate + 0.01) / (1.01 - rate)))
    sizes = np.array([len(s) for s in sets])
    groups, own, copies = word_swaps(sets, identity) if swaps is None else swaps
    # copies may have what no text has
    names, column = np.unique(np.concatenate([*sets, np.array(own, dtype="<i4")]), return_inverse=True)
    column = column[: sizes.sum()]
    often = np.bincount(column, minlength=len(names)) >= 3  # what one or two sampled texts have says nothing about others
    often |= np.isin(names, own)
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), sizes)[often[column]]
    col = place[column[often[column]]]
    names = names[often]
    d, n = len(names), len(sets)
    at = {int(b): k for k, b in enumerate(names)}
    terms = np.array([at[i] for i in own], dtype=int)
    has = np.array([[f in g for g in groups] for f in own], dtype=float)  # feature, term
    term = np.array([int.from_bytes(c[:2], "little") for c in copies], dtype=int)
    lacks = np.unpackbits(np.array([list(c[2:]) for c in copies], dtype=np.uint8), axis=1)[:, : len(own)] if copies else None
    partners = ~np.eye(len(groups), dtype=bool) if partners is None else partners
    shares = partners / np.maximum(partners.sum(1), 1)[:, None] / n  # of each text, the mean of its copies
    seen = np.array(list(copies.values()), dtype=float)[:, None] * shares[term] if copies else None  # copy, other term
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2, b1, b2 = np.zeros(d), np.zeros(d), 0.0, 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=n) + b, -30, 30)))
        g = (p - y) / n
        grad = np.bincount(col, weights=g[row], minlength=d) + ridge * w
        if len(groups) > 1 and lacks is not None:
            added = (lacks * w[terms]) @ has
            change = seen * (added - added[np.arange(len(term)), term][:, None])
            # each copy pulls on what it adds and, the other way, on what it lost
            grad[terms] += penalty * 2 * (lacks * (change @ has.T - change.sum(1)[:, None] * has[:, term].T)).sum(0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.99 * b2 + 0.01 * g.sum() ** 2
        down, down2 = 1 - 0.9**k, 1 - 0.99**k
        rate = 0.1 * min(1.0, 2 - 2 * k / steps)
        pace = rate / (np.sqrt(m2 / down2) + 1e-6)
        w = w - pace * m1 / down
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        b -= rate * (b1 / down) / (np.sqrt(b2 / down2) + 1e-6)
    return {int(names[k]): float(w[k]) for k in np.flatnonzero(w)}, float(b)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "toxic", identity_terms: dict[str, list[str]] | list[str] = IDENTITY_TERMS, sample: int = SAMPLE, penalty: float = 1.0
) -> tuple[dict[int, float], float]:
    """Fit on labelled rows outside the held-out fold. Null labels are none; a 1 beside a 0 for one id counts as 1.

    An id with several texts counts by one of them, the smallest. Without labels or texts every score is the same.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), F.col(column).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        swaps = Swaps(identity_terms, features)
        for batch in (p for whole in batches for p in small_parts(whole, "text")):
            sets = [np.array(feature_set(t.as_py(), features), dtype="<i4").tobytes() for t in batch.column("text")]
            copies = [swaps.of(t.as_py(), features) for t in batch.column("text")]
            arrays = [batch.column("y").cast(pa.int32()), pa.array(sets, type=pa.binary()), pa.array(copies, type=pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "features", "copies"])

    got = texts.mapInArrow(run, "y int, features binary, copies array<binary>").collect()
    sets = [np.frombuffer(bytes(r.features), dtype="<i4") for r in got]
    all_terms = Swaps(identity_terms, Features())
    copies = Counter(bytes(c) for r in got for c in r.copies)
    return train(sets, np.array([r.y for r in got], dtype=float), [bucket(t) for t in all_terms.words], penalty=penalty, swaps=(all_terms.groups, all_terms.names, copies), partners=all_terms.partners)


def score(docs: DataFrame, model: tuple[dict[int, float], float], column: str = "text", out: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every row's whole text; null text scores as the empty text.

    Repeated rows score alike, an empty table gives an empty one, texts of any length are read whole. Other columns are kept,
    whatever their names, but for one named `out`, which gives way.
    """
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(weights.keys())
        for batch in (p for whole in batches for p in small_parts(whole, column)):
            logits = [bias + sum(weights[k] for k in feature_set(t.as_py(), features)) for t in batch.column(column)]
            made = 1 / (1 + np.exp(-np.clip(np.array(logits, dtype=float), -30, 30)))
            yield add_columns(batch, **{out: pa.array(made, type=pa.float64())})

    return docs.mapInArrow(run, with_fields(docs, **{out: "double"}))
