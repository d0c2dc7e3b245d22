"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound by
multiplying its letters' vectors, each rotated by its place; a text's profile is
the bundle (sum) of its trigrams' vectors.  A language's prototype is the bundle
of its training texts, each scaled to unit length, less the mean over languages.
A text belongs to the language whose prototype has the largest cosine with its
profile less that mean.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Components of a vector.
DIMENSIONS = 1024
#: Letters that have vectors of their own; others share them by code point.
LETTERS = 1024
#: Training rows of each language, in expectation: a bounded, documented sample.
SAMPLE = 4000
#: Trigram vectors that a worker keeps.
_KEPT = 16_384
UNKNOWN = "und"


def letter_table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))


def _fold_table() -> np.ndarray:
    """Code point -> letter number from 1; 0: no letter.  Case is folded; letters
    beyond the table share its numbers."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = 1 + (ord(low[0]) if len(low) == 1 else c) % (LETTERS - 1)
    return out


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Letter vectors and numbers, small: a worker keeps them."""
    return letter_table(), _fold_table()


class Profiles:
    """Texts to vectors.  Built anew in each task, so that a worker's other tasks have its memory."""

    def __init__(self):
        letters, self.fold = _tables()
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.row: dict[int, int] = {}
        self.vectors = np.empty((_KEPT, DIMENSIONS), np.float32)

    def codes(self, text: str) -> np.ndarray:
        """Trigram codes; runs of other characters become one separator (0)."""
        letters = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = np.concatenate([[0], letters, [0]])
        letters = letters[np.append(True, (letters[1:] != 0) | (letters[:-1] != 0))]
        if len(letters) < 3:
            return np.empty(0, np.int64)
        a, b, c = letters[:-2].astype(np.int64), letters[1:-1].astype(np.int64), letters[2:].astype(np.int64)
        return (a * LETTERS + b) * LETTERS + c

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct codes, from memory where they are there."""
        if len(self.row) + len(codes) > _KEPT:
            self.row.clear()
            if len(codes) > _KEPT:
                return self.make(codes)
        new = [c for c in codes.tolist() if c not in self.row]
        if new:
            at = len(self.row)
            self.vectors[at:at + len(new)] = self.make(np.array(new))
            self.row.update(zip(new, range(at, at + len(new))))
        return self.vectors[[self.row[c] for c in codes.tolist()]]

    def make(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // LETTERS // LETTERS, codes // LETTERS % LETTERS, codes % LETTERS
        return (self.first[a] * self.second[b] * self.third[c]).astype(np.float32)

    def profile(self, text: str | None) -> np.ndarray | None:
        """The bundle at unit length; None if the text has no letter."""
        codes = self.codes(text) if text else ()
        if not len(codes):
            return None
        distinct, counts = np.unique(codes, return_counts=True)
        total = np.zeros(DIMENSIONS, np.float32)
        for i in range(0, len(distinct), _KEPT // 2):
            total += counts[i:i + _KEPT // 2].astype(np.float32) @ self.rows(distinct[i:i + _KEPT // 2])
        size = np.linalg.norm(total)
        return total / size if size else total


def _fold_of(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, prototypes, mean) from columns text, lang and key.

    About `sample` rows of each language are taken by a hash of key; their vectors
    are summed in the tasks, so one vector a task and language is moved.
    """
    labelled = bounded_batches(labelled).where("lang IS NOT NULL AND text IS NOT NULL")
    rates = [(r.lang, min(1.0, sample / r.n)) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # one row a language
    if not rates:
        return [], np.empty((0, DIMENSIONS)), np.zeros(DIMENSIONS)
    chance = (F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) / float(1 << 30))
    rate = F.create_map(*[F.lit(x) for pair in rates for x in pair])

    def add(batches):
        p, total = Profiles(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = p.profile(text)
                if v is not None:
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    parts = labelled.where(chance < rate[F.col("lang")]).select("text", "lang").mapInArrow(add, "lang string, v binary")

    def join(key, table):
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([sum(np.frombuffer(v) for v in table.column("v").to_pylist()).tobytes()], pa.binary())], names=["lang", "v"])

    found = sorted((r.lang, np.frombuffer(bytes(r.v))) for r in parts.groupBy("lang").applyInArrow(join, "lang string, v binary").collect()) if rates else []
    if not found:
        return [], np.empty((0, DIMENSIONS)), np.zeros(DIMENSIONS)
    unit = np.stack([v / (np.linalg.norm(v) or 1.0) for _, v in found])
    mean = unit.mean(0) if len(unit) > 1 else np.zeros(DIMENSIONS)
    near = unit - mean
    return [lang for lang, _ in found], near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12), mean


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, mean: np.ndarray, columns: list[str]) -> DataFrame:
    """The named columns of docs, lang_pred and score.

    docs has text, by itself or, to pass it once, in the last of columns, a struct.
    score is the best cosine, 0 where it is negative; a null text
    or one without letters is `und` with score 0, as is all if nothing was
    learned.  Ties go to the first language by name.
    """
    inside = "text" not in docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((languages, prototypes.astype(np.float32), mean.astype(np.float32)))

    def run(batches):
        names, table, middle = shared.value
        p = Profiles()
        for batch in batches:
            found, scores = [], []
            held = batch.column(batch.num_columns - 1)
            for text in (pc.struct_field(held, "text") if inside else held).to_pylist():
                v = p.profile(text) if names else None
                if v is None:
                    found.append(UNKNOWN), scores.append(0.0)
                    continue
                v = v - middle
                near = table @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(near))
                found.append(names[best]), scores.append(min(1.0, max(0.0, float(near[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.columns if inside else batch.columns[:-1]), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    kept = bounded_batches(docs).select(*columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return (kept if inside else docs.select(*columns, F.col("text").cast("string").alias("_text"))).mapInArrow(run, schema)


def train_rows(docs: DataFrame) -> DataFrame:
    """text, lang and key of the rows that may be learned from."""
    doc_id = F.col("doc_id").cast("long")
    return docs.where(_fold_of(doc_id) != 2).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), doc_id.alias("key"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 4
    is not 2 (null doc_id are not learned from); the others are held out.  Repeated rows are
    predicted alike; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(_fold_of(F.col("doc_id")) == 2, F.lit(False))
    model = learn(train_rows(docs), sample)
    return predict(docs.withColumn("held_out", held), *model, ["doc_id", "held_out"])
