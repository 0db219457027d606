"""Language identification: the family first, then pairwise linear support vector machines within it (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemart.llm.toxicity import held_out

UNDETERMINED = "und"
SIZES = (1, 2, 3, 4)  # characters of an n-gram
BITS = 17  # n-grams are hashed to 2**BITS features
TRAIN_ROWS = 1600  # rows the model is fitted on, shared evenly by the languages
PARTS = 64  # of a language, that are ranked by themselves first
LEAST_ROWS = 20  # of a language, however many there are
TRAIN_CHARS = 50_000  # longer texts are not taken into that sample; every text is predicted whole
COST = 10.0  # of a training row on the wrong side
PASSES = 300  # over the rows at most; fewer when no row moves any more
STEEP = 3.0  # of the curve from margins to scores

# Closely related languages, by ISO 639-1 code. A code in none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy fo yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi bn pa gu mr ne ur si",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk ky uz tk tt ug",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "dravidian": "ta te ml kn",
    "malayic": "id ms jv su tl",
    "tai": "th lo",
    "austroasiatic": "vi km",
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), code)


class Grams:
    """Distinct hashed n-grams of the letters of a text: lower-cased, a blank for each run of anything else, and one at
    both ends, so that beginnings and ends of words count as such."""

    def __init__(self) -> None:
        self.letter = np.array([chr(i).isalpha() for i in range(1 << 16)])
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.letter[np.minimum(codes, 0xFFFF)]
        for c in np.unique(codes[codes > 0xFFFF]):
            inside[codes == c] = chr(c).isalpha()
        if not inside.any():
            return np.zeros(0, np.int32)
        before = np.concatenate([[False], inside[:-1]])
        codes = np.where(inside, codes, np.uint32(32))[inside | before]
        h = codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
        parts = []
        for n in range(1, SIZES[-1] + 1):
            if len(codes) < n:
                break
            if n > 1:
                h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1:]
            if n in SIZES:
                parts.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n) >> np.uint32(32 - BITS)).astype(np.int32))
        grams = np.concatenate(parts)
        place = np.arange(len(grams), dtype=np.int32)
        self.last[grams] = place  # of equal n-grams one place stays
        return grams[self.last[grams] == place]


def separate(texts: list[np.ndarray], sides: np.ndarray) -> np.ndarray:
    """Weights of the features and, last, the constant: a linear support vector machine with squared hinge loss, solved
    in the dual row by row. A row is its n-grams, each of weight 1 / sqrt(their number), and a constant 1.

    Both sides (+1, -1) cost alike in sum. With one side alone, the constant says which.
    """
    w = np.zeros((1 << BITS) + 1)
    if len(set(sides.tolist())) < 2:
        w[-1] = sides[0] if len(sides) else 0
        return w
    per_side = {s: len(sides) / 2 / (sides == s).sum() for s in (-1, 1)}
    rows = [np.append(t, 1 << BITS) for t in texts]
    values = [np.append(np.full(len(t), 1 / np.sqrt(len(t))), 1.0) for t in texts]
    slack = np.array([1 / (2 * COST * per_side[s]) for s in sides])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(len(rows))
    for _ in range(PASSES):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slope = sides[i] * (w[rows[i]] @ values[i]) - 1 + slack[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            new = max(alpha[i] - slope / (2 + slack[i]), 0.0)  # 2: the squared length of every row
            w[rows[i]] += (new - alpha[i]) * sides[i] * values[i]
            alpha[i] = new
            largest = max(largest, abs(slope))
        if largest < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[list[str]] = field(default_factory=list)  # the languages of each
    weights: np.ndarray = field(default_factory=lambda: np.zeros(((1 << BITS) + 1, 0), np.float32))  # a column per machine
    pairs: list[list[tuple[int, int, int]]] = field(default_factory=list)  # per family: two of its languages, and their column

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        if not self.families or not len(grams):
            return UNDETERMINED, 0.0
        margins = self.weights[grams].sum(0, dtype=np.float64) / np.sqrt(len(grams)) + self.weights[-1]
        among = np.exp(STEEP * np.clip(margins[:len(self.families)], -9, 9))
        best = int(among.argmax())
        langs, score = self.families[best], among[best] / among.sum()
        votes, lead = np.zeros(len(langs)), np.zeros(len(langs))
        for a, b, column in self.pairs[best]:
            margin = margins[column]
            votes[a if margin >= 0 else b] += 1
            lead[a] += margin
            lead[b] -= margin
        winner = int(np.lexsort((-lead, -votes))[0])  # most votes, then the largest sum of margins, then the first name
        for a, b, column in self.pairs[best]:
            if winner in (a, b):
                score *= 1 / (1 + np.exp(-STEEP * np.clip(margins[column] if winner == a else -margins[column], -9, 9)))
        return langs[winner], float(min(max(score, 0.0), 1.0))


def solve(texts: list[np.ndarray], langs: list[str]) -> Model:
    """One machine per family against the others, and one per pair of languages of a family."""
    named: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        named.setdefault(family(lang), []).append(lang)
    own = np.array([family(x) for x in langs])
    columns = [separate(texts, np.where(own == name, 1, -1)) for name in named]
    pairs = []
    for members in named.values():
        pairs.append([])
        for (a, first), (b, second) in combinations(enumerate(members), 2):
            rows = [i for i, x in enumerate(langs) if x in (first, second)]
            pairs[-1].append((a, b, len(columns)))
            columns.append(separate([texts[i] for i in rows], np.array([1 if langs[i] == first else -1 for i in rows])))
    return Model(list(named.values()), np.column_stack(columns).astype(np.float32), pairs) if columns else Model()


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample of ``docs`` (doc_id, text, lang): of each language the first rows by a hash of id and
    text. Equal rows count once. Only hashes are ranked; the chosen rows, ``rows`` in all, are then looked up."""
    keyed = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS) & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    narrow = keyed.select("lang", "mark")
    langs = narrow.select("lang").distinct().count()
    share = max(LEAST_ROWS, rows // max(langs, 1))
    # the first of every part of a language, then the first of these: the last task of a language sees PARTS * share rows
    parts = Window.partitionBy("lang", "part").orderBy("mark")
    first = narrow.withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(PARTS))).withColumn("no", F.row_number().over(parts)).filter(F.col("no") <= share)
    spec = Window.partitionBy("lang").orderBy("mark")
    chosen = first.withColumn("no", F.row_number().over(spec)).filter(F.col("no") <= share).select("lang", "mark").distinct()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column(0), "mark": batch.column(1),
                "grams": pa.array([grams(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())})

    found = (
        keyed.join(F.broadcast(chosen), ["lang", "mark"]).select("lang", "mark", "text").dropDuplicates(["lang", "mark"])
        .mapInArrow(extract, "lang string, mark long, grams binary").orderBy("lang", "mark").toArrow()
    )
    return solve([np.frombuffer(g, np.int32) for g in found.column(2).to_pylist()], found.column(0).to_pylist())


def identify(docs: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs``, each text read whole.

    Learned are text and lang of rows outside the held-out fold whose lang is not null; a prediction depends on the text
    alone. A text that is null, empty or without letters is ``und`` with score 0; so is every text when there is nothing
    to learn from. With one language learned, that is the answer. Ties fall to the first language by name. A null doc_id
    counts as an empty one for the fold. Repeated rows are predicted alike; extra columns are not read; an empty table
    gives no rows.
    """
    kept = ~held_out(F.col("doc_id"), folds, fold)
    model = fit(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(kept), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [model.predict(grams(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([x for x, _ in found], pa.string()),
                "score": pa.array([s for _, s in found], pa.float64())})

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
