"""Language identification by string kernels.

A text is lower-cased, everything but letters becomes one blank, and its blended spectrum is the
set of all 1- to ``SPECTRUM``-grams of characters, hashed to ``PLACES`` presence bits. The kernel of
two texts is the number of shared bits over the root of the product of their counts. ``LANDMARKS``
texts give Nyström features (kernel values times the inverse root of the landmarks' own kernel
matrix), on which one ridge regression per language (one versus the rest) is solved. Scoring is a
product of a batch's presence matrix with the landmarks, and one with the weights.

What a text shares with its nearest landmarks, beyond chance and piece by piece, is its evidence; the
least for a learned language is a share of the usual evidence of labelled rows.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_PER_LANG`` a language, chosen by
the hash of doc_id among the rows allowed for training); every text is scored whole.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any
training row everything is ``und``; equal scores take the first language in order; a null doc_id
counts as the empty string for the hold-out; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix

SPECTRUM, PLACES = 3, 1 << 14
SAMPLE_PER_LANG, LANDMARKS_PER_LANG = 400, 32
RIDGE = 1e-4
BATCH = 128
#: Characters of a piece (long texts hold every common gram), and the share of the usual evidence below
#: which a text is in no learned language.
PIECE, FOREIGN = 1000, 0.6
NEAREST = 8
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
_MUL = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def held_out(doc_id="doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _letters(text: str | None) -> np.ndarray | None:
    """Code points, one blank for each run of other characters than letters; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    return c[letter | np.append(True, letter[:-1])]


def _places(c: np.ndarray) -> np.ndarray:
    out, h = [], np.zeros(len(c), np.uint32)
    for k in range(SPECTRUM):
        if len(c) <= k:
            break
        h = (h[: len(c) - k] ^ (c[k:] * _MUL[k])) * _MUL[3]
        h ^= h >> np.uint32(15)
        out.append(h % np.uint32(PLACES))
    return np.unique(np.concatenate(out))


def grams(text: str | None) -> np.ndarray | None:
    """Places of the text's blended spectrum, or None if it has no letter."""
    c = _letters(text)
    return None if c is None else _places(c)


def pieces(text: str | None) -> list[np.ndarray]:
    """Gram places of the text's pieces of about ``PIECE`` characters (no letter: none)."""
    c = _letters(text)
    return [] if c is None else [_places(x) for x in np.array_split(c, max(1, round(len(c) / PIECE)))]


def presence(rows: list[np.ndarray | None]) -> np.ndarray:
    """Presence matrix, each row scaled to length 1 (no letter: zeros)."""
    x = np.zeros((len(rows), PLACES), np.float32)
    for i, g in enumerate(rows):
        if g is not None:
            x[i, g] = 1 / np.sqrt(len(g))
    return x


def overlap(rows: list[np.ndarray], landmarks: np.ndarray) -> np.ndarray:
    """Shared places over the smaller count of both, less what chance would share: 0 is chance, 1 all.
    Unlike the kernel it does not fall with the difference in length."""
    n = np.array([[len(g)] for g in rows], np.float64)
    m = (landmarks > 0).sum(1).astype(np.float64)[None, :]
    shared = (presence(rows) @ landmarks.T) * np.sqrt(n * m)
    chance = n * m / PLACES
    return (shared - chance) / np.maximum(np.minimum(n, m) - chance, 1e-9)


def nearest(o: np.ndarray) -> np.ndarray:
    """Mean of each row's largest overlaps, ``NEAREST`` at most: a single long landmark proves little."""
    return np.sort(o, axis=1)[:, -NEAREST:].mean(1)


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # scaled presence, one row each
    weights: np.ndarray  # landmarks x languages, Nyström root included
    offset: np.ndarray
    bound: float = 0.0  # least evidence of a text in a learned language

    def scores(self, rows: list[np.ndarray | None]) -> np.ndarray:
        return (presence(rows) @ self.landmarks.T) @ self.weights + self.offset

    def evidence(self, parts: list[list[np.ndarray]]) -> list[float]:
        """Of each text the mean overlap of its pieces with their nearest landmarks (no letter: 0)."""
        flat = [g for p in parts for g in p]
        best = np.concatenate([np.zeros(0), *(nearest(overlap(flat[i : i + BATCH], self.landmarks)) for i in range(0, len(flat), BATCH))])
        ends = np.cumsum([len(p) for p in parts])
        return [float(best[e - len(p) : e].mean()) if p else 0.0 for p, e in zip(parts, ends, strict=True)]


def training_rows(docs: DataFrame, per_lang: int) -> DataFrame:
    """lang, text, place (order within the language): at most ``per_lang`` rows a language. A
    threshold on the hash, from the languages' counts, keeps the sort to little more than those."""
    d = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return d.limit(0).select("lang", "text", F.lit(0).alias("place"))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * per_lang + 100) / n)) for k, n in counts.items()], "lang string, share double")
    at = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    d = d.select("lang", "text", "doc_id", at.alias("at")).join(F.broadcast(share), "lang").filter("at < share")
    w = Window.partitionBy("lang").orderBy("at", "doc_id", "text")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_lang).select("lang", "text", "place")


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, landmarks: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model | None:
    """Fitted on the driver from the sample's gram places (the bounded sample alone gets there)."""

    def rows(batches):
        for b in batches:
            got = [grams(t.as_py()) for t in b.column(1)]
            first = [next(iter(pieces(t.as_py())), None) for t in b.column(1)]
            keep = pa.array([i for i, g in enumerate(got) if g is not None], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(keep), b.column(2).take(keep), *(pa.array([g.astype("<u2").tobytes() for g in x if g is not None], pa.binary()) for x in (got, first))],
                ["lang", "place", "grams", "piece"],
            )

    sample = training_rows(docs, per_lang).mapInArrow(rows, "lang string, place int, grams binary, piece binary").orderBy("lang", "place").collect()
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    got = [np.frombuffer(r["grams"], "<u2").astype(np.int64) for r in sample]
    chosen = [i for lang in langs for i in [k for k, r in enumerate(sample) if r["lang"] == lang][:landmarks]]
    marks = presence([got[i] for i in chosen])
    own = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    kernel = np.concatenate([presence(got[i : i + BATCH]) @ marks.T for i in range(0, len(got), BATCH)]).astype(np.float64)
    phi = kernel @ root
    y = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in langs] for r in sample])
    centre, offset = phi.mean(0), y.mean(0)
    phi, y = phi - centre, y - offset
    beta = np.linalg.solve(phi.T @ phi + ridge * len(sample) * np.eye(len(chosen)), phi.T @ y)
    # usual evidence of labelled rows by landmarks other than themselves
    first = [np.frombuffer(r["piece"], "<u2").astype(np.int64) for r in sample]
    near = np.concatenate([overlap(first[i : i + BATCH], marks) for i in range(0, len(first), BATCH)])
    near[chosen, np.arange(len(chosen))] = 0
    bound = FOREIGN * float(np.median(nearest(near)))
    return Model(langs, marks, (root @ beta).astype(np.float32), (offset - centre @ beta).astype(np.float32), bound)


def predict(docs: DataFrame, model: Model | None, evidence: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` plus lang_pred and score (0 to 1), and evidence if asked, their names after
    ``prefix``; only ``text`` is looked at."""
    kept = docs.columns
    schema = docs.schema

    def rows(batches):
        for b in batches:
            lang, score, proof = [], [], []
            for lo in range(0, b.num_rows, BATCH):
                got = [grams(t.as_py()) for t in b.column(kept.index("text")).slice(lo, BATCH)]
                if evidence:
                    parts = [pieces(t.as_py()) for t in b.column(kept.index("text")).slice(lo, BATCH)]
                    proof.extend(model.evidence(parts) if model is not None else [0.0] * len(parts))
                if model is None:
                    got = [None] * len(got)
                else:
                    s = model.scores(got)
                for i, g in enumerate(got):
                    if g is None:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        k = int(np.argmax(s[i]))
                        lang.append(model.langs[k])
                        score.append(float(min(1.0, max(0.0, (s[i, k] + 1) / 2))))
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), *([pa.array(proof, pa.float64())] if evidence else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*kept, *added])

    added = [prefix + c for c in ("lang_pred", "score", *(["evidence"] if evidence else []))]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return docs.mapInArrow(rows, ", ".join([ddl, *(f"`{c}` {t}" for c, t in zip(added, ("string", "double", "double"), strict=False))]))


def in_learned_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that have no letter or less evidence than the model's bound. The
    scores cannot tell these: they add up to 1 however little a text shares with any landmark. Their
    margin is not asked either, so a text that mixes learned languages stays."""
    model = fit(docs.select("doc_id", "text", "lang"))
    prefix = free_prefix(docs.columns)
    scored = predict(docs, model, evidence=True, prefix=prefix)
    known = (F.col(prefix + "lang_pred") != UNKNOWN) & (F.col(prefix + "evidence") >= (model.bound if model is not None else 0.0))
    return scored.filter(known).select(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    d = docs.select("doc_id", "text")
    return predict(d, fit(docs.select("doc_id", "text", "lang"))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
