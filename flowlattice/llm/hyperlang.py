"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) its
trigrams' vectors; a language's prototype bundles the unit vectors of its learning texts.
A text gets the language whose prototype has the largest cosine with its own vector.

Text is lower-cased; whatever is no letter parts words and becomes one blank.

The prototypes are fitted on a bounded sample of each language's rows.  Tasks' sums are added up by language and
dimension in Spark; the driver gets one vector a language, and more than ``LANGUAGES`` of them are an error.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.  Nothing to learn
from: every text is ``und``.  A null doc_id folds as the empty text.  Repeated rows are
predicted alike.  Ties go to the smaller language value.  Columns beyond doc_id, text and
lang are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.common import BROADCAST_ROWS, held_out, slices, written

DIM = 2048
#: Documents of each language to fit its prototype on, about; chosen by a hash of doc_id and text.
SAMPLE = 1500
#: The sample is dealt to so many tasks, each of which returns one vector a language; and languages at most.
FIT_TASKS, LANGUAGES = 12, 2000
#: Documents whose counts are multiplied at once, and their characters at most (one document may exceed them).
CHUNK, CHUNK_CHARS = 256, 1_500_000
#: Trigrams whose vectors are held at once.
GRAMS = 2048
SEED = 20_011


class Encoder:
    """Turns texts into hypervectors; keeps the letters' vectors it has drawn."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.letters = np.fromiter((chr(i).isalpha() for i in range(0x20000)), dtype=bool, count=0x20000)
        self.drawn: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.drawn:
            bits = np.random.default_rng((SEED, code)).integers(0, 2, self.dim, dtype=np.int8)
            self.drawn[code] = (2 * bits - 1).astype(np.int8)
        return self.drawn[code]

    def symbols(self, text: str) -> np.ndarray:
        """Code points of the letters, with one 32 between and around words; empty without letters."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        low = codes < 0x20000
        if low.all():
            known = self.letters[codes]
        else:
            known = np.where(low, self.letters[np.where(low, codes, 0)], [chr(c).isalpha() for c in codes.tolist()])
        if not known.any():
            return codes[:0]
        out = np.where(known, codes, 32)
        return out[known | np.concatenate(([True], known[:-1]))]

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """One row a text; all zeros where there is no letter."""
        rows = [self.symbols(t) if t else np.zeros(0, "<u4") for t in texts]
        out = np.zeros((len(rows), self.dim), np.float32)
        lengths = np.array([max(len(r) - 2, 0) for r in rows])
        if not lengths.sum():
            return out
        flat = np.concatenate(rows)
        alphabet, flat = np.unique(flat, return_inverse=True) if len(flat) < 4096 else self.compact(flat)
        k = len(alphabet)
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        at = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        grams = (flat[at].astype(np.int64) * k + flat[at + 1]) * k + flat[at + 2]
        if k**3 <= 4_000_000:
            seen = np.flatnonzero(np.bincount(grams, minlength=k**3))
            place = np.zeros(k**3, np.int32)
            place[seen] = np.arange(len(seen))
            grams = place[grams]
        else:
            seen, grams = np.unique(grams, return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in alphabet])
        first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
        doc = np.repeat(np.arange(len(rows)), lengths)
        for lo in range(0, len(seen), GRAMS):
            part = seen[lo : lo + GRAMS]
            inside = slice(None) if len(seen) <= GRAMS else (grams >= lo) & (grams < lo + len(part))
            counts = np.bincount(doc[inside] * len(part) + (grams[inside] - lo), minlength=len(rows) * len(part))
            bound = first[part // (k * k)] * second[part // k % k] * table[part % k]
            out += counts.reshape(len(rows), len(part)).astype(np.float32) @ bound.astype(np.float32)
        return out

    @staticmethod
    def compact(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """np.unique with inverse by counting."""
        alphabet = np.flatnonzero(np.bincount(flat))
        place = np.zeros(int(alphabet[-1]) + 1, np.int32)
        place[alphabet] = np.arange(len(alphabet))
        return alphabet, place[flat]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - lo >= CHUNK or size >= CHUNK_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their unit prototypes; learns from rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    counts = written(rows.groupBy(F.col("lang").alias("c_lang")).agg(F.count("*").alias("c")), "langs")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) * F.col("c")  # a language of few rows keeps them all
    rows = rows.join(counts, F.col("lang") == F.col("c_lang")).where(spot < F.lit(sample << 30))
    rows = rows.select("lang", "doc_id", "text").distinct()  # rows that repeat count once

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = Encoder(), {}
        for b in slices(batches):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                got = unit(enc.vectors(texts[lo:hi])).astype(np.float64)
                for lang, v in zip(langs[lo:hi], got, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        # whole millionths, so that sums don't depend on their order
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([np.rint(v * 1e6).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))})

    parts = rows.select("lang", "text").repartition(FIT_TASKS).mapInArrow(bundle, "lang string, v array<long>")
    whole = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    whole = whole.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
    found = [(r.lang, np.array(r.v, np.float64)) for r in whole.orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = [(lang, v) for lang, v in found if v.any()]
    return [lang for lang, _ in found], unit(np.array([v for _, v in found])) if found else np.zeros((0, DIM))


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs`` (but any of those names), then the language and its cosine (0 at least)."""
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(kept).schema
    model = np.asarray(prototypes, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder()
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for lo, hi in chunks(texts):
                v = enc.vectors(texts[lo:hi])
                if not len(langs):
                    continue
                cos = np.round(unit(v) @ model.T, 5)
                hit = np.flatnonzero(v.any(axis=1))
                best = cos.argmax(axis=1)
                pred[lo + hit] = np.array(langs, object)[best[hit]]
                score[lo + hit] = np.clip(cos[np.arange(hi - lo), best], 0, 1)[hit]
            cols = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(kept).mapInArrow(run, f"{fields}, {names[0]} string, {names[1]} double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; see the module's text."""
    langs, prototypes = fit(docs.select("doc_id", "text", "lang"), sample)
    out = predict(docs.select("doc_id", "text"), langs, prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
