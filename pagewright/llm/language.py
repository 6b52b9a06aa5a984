"""Operator 3: language identification in two steps, family first and then the languages within it.

Texts are counted as hashed character trigrams over lower-cased letters and word ends. A linear softmax model picks the
family; within it, linear support vector machines, one for each pair of languages, vote. All models are fitted on one
bounded sample of labelled texts and applied to whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The branch of common languages. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "celtic": ("ga", "gd", "cy", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Hash buckets of the trigrams.
BUCKETS = 1 << 12
#: Labelled texts that are taken for fitting, about, of each language.
SAMPLE_PER_LANG = 600
#: Texts that are taken in all, about, however many languages there are: 48 MB of counts on the driver.
SAMPLE_TEXTS = 6_000
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Trigram counts of one whole text, square-rooted and scaled to length 1; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = (codes >= 97) & (codes <= 122)
    other = np.nonzero(codes > 127)[0]
    if len(other):
        kinds = {c: chr(c).isalpha() for c in np.unique(codes[other]).tolist()}
        plain[other] = np.fromiter(map(kinds.__getitem__, codes[other].tolist()), bool, len(other))
    if not plain.any():
        return None
    found = np.zeros(buckets, np.float32)
    step = 1 << 20
    for at in range(0, len(codes), step):  # the three kinds of position need their neighbours
        part, own = codes[max(0, at - 2) : at + step + 1], plain[max(0, at - 2) : at + step + 1]
        line = np.zeros(len(part) + 2, np.uint64)
        line[1:-1] = np.where(own, part, 0)
        line = line[np.concatenate(([True], (line[1:] != 0) | (line[:-1] != 0)))]  # runs of other characters count once
        if len(line) < 3:
            continue
        mixed = (line[:-2] * np.uint64(0x9E3779B1) ^ line[1:-1] * np.uint64(0x85EBCA77) ^ line[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
        found += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets).astype(np.float32)
    found = np.sqrt(found)
    return found / np.linalg.norm(found)


@dataclass(frozen=True)
class Model:
    """Languages, families, the softmax over families, and a separating plane for each pair of languages in a family."""

    langs: list[str]
    families: list[str]
    family_weights: np.ndarray
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1: the family's probability times the mean of the winner's votes."""
        x = counts(text, self.family_weights.shape[1] - 1)
        if x is None or not self.langs:
            return UNKNOWN, 0.0
        logits = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        odds = np.exp(logits - logits.max())
        family = int(odds.argmax())
        mine = [i for i, lang in enumerate(self.langs) if family_of(lang) == self.families[family]]
        votes, sums = dict.fromkeys(mine, 0), dict.fromkeys(mine, 0.0)
        for k, (i, j) in enumerate(self.pairs):
            if i in votes:
                sure = float(1 / (1 + np.exp(-4 * (self.pair_weights[k, :-1] @ x + self.pair_weights[k, -1]))))
                votes[i if sure >= 0.5 else j] += 1
                sums[i] += sure
                sums[j] += 1 - sure
        best = max(mine, key=lambda i: (votes[i], sums[i], -i))
        share = sums[best] / (len(mine) - 1) if len(mine) > 1 else 1.0
        return self.langs[best], float(min(1.0, max(0.0, odds[family] / odds.sum() * share)))


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 200) -> np.ndarray:
    """Weights (classes, features) by full-batch gradient steps with momentum; the last feature is 1; the classes weigh the same."""
    w, speed = np.zeros((classes, x.shape[1]), np.float32), 0.0
    weight = ((1 / np.bincount(y, minlength=classes).clip(1))[y][:, None] / classes).astype(np.float32)  # a wider type would copy x in each round
    for _ in range(rounds if classes > 1 else 0):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        speed = 0.9 * speed - 4.0 * ((p * weight).T @ x + 1e-5 * w)
        w = (w + speed).astype(np.float32)
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """A plane (features) of least squared hinge loss with a quadratic penalty; the last feature is 1; y is 1 or -1; the sides weigh the same."""
    w, speed = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w))
        speed = 0.9 * speed - 1.0 * (-(weight * slack * y) @ x + 1e-4 * w)
        w = (w + speed).astype(np.float32)
    return w


def fit_sample(rows: list[tuple[str, np.ndarray]]) -> Model:
    """All models from (language, counts) rows."""
    langs = sorted({lang for lang, _ in rows})
    families = sorted({family_of(lang) for lang in langs})
    if not rows:
        return Model([], [], np.zeros((0, BUCKETS + 1), np.float32), [], np.zeros((0, BUCKETS + 1), np.float32))
    x = np.ones((len(rows), len(rows[0][1]) + 1), np.float32)
    for k, (_, v) in enumerate(rows):
        x[k, :-1] = v
    y = np.array([langs.index(lang) for lang, _ in rows])
    group = np.array([families.index(family_of(lang)) for lang in langs])
    pairs = [(i, j) for i, j in combinations(range(len(langs)), 2) if group[i] == group[j]]
    planes = [fit_svm(x[(y == i) | (y == j)], np.where(y[(y == i) | (y == j)] == i, 1.0, -1.0).astype(np.float32)) for i, j in pairs]
    planes = np.stack(planes) if planes else np.zeros((0, x.shape[1]), np.float32)
    return Model(langs, families, fit_softmax(x, group[y], len(families)), pairs, planes)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE_TEXTS) -> Model:
    """Fit on about `per_lang` distinct texts of each language (all, if there are fewer), chosen by a hash of the text.

    The bound: the driver gets languages * per_lang, but at most about `most`, count vectors of BUCKETS half-precision numbers (8 KB each), and no
    text. Of more than most / per_lang languages each has an equal part of `most`; of more than `most` / 4 nothing can be learned, and an error is raised. Rows with a null language, a null text or no letter aren't used. Copies of a text count once, in the share taken too.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash")
    )
    lettered = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", "hash").distinct()
    sizes = {r.lang: r["count"] for r in lettered.groupBy("lang").count().collect()}
    if not sizes:
        return fit_sample([])
    if len(sizes) > most / 4:
        raise ValueError(f"{len(sizes)} languages are too many for a sample of {most} texts")
    per_lang = min(per_lang, most // len(sizes))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, per_lang / n))])
    taken = F.pmod(F.col("hash"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("text")]
            kept = [i for i, v in enumerate(found) if v is not None]
            cells = [found[i].astype(np.float16).tobytes() for i in kept]
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(kept, pa.int64())), batch.column("hash").take(pa.array(kept, pa.int64())), pa.array(cells, pa.binary())], ["lang", "hash", "v"])

    vectors = rows.filter(taken).mapInArrow(run, "lang string, hash long, v binary").groupBy("lang", "hash").agg(F.first("v").alias("v"))
    got = vectors.toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    return fit_sample([(lang, np.frombuffer(v.as_buffer(), np.float16)) for lang, v in zip(got.column("lang").to_pylist(), got.column("v"), strict=True)])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
    """The columns `keep` (all, unless given) with lang_pred and score.

    lang_pred is a language the model has learned, or `und` with score 0 where the text is null or has no letter, or
    nothing was learned. Whole texts are read, in slices; columns of `docs` named lang_pred or score are replaced.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    kept = docs.select(*(keep if keep is not None else [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            names = [*batch.schema.names[:-1], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], langs, scores], names)

    return kept.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is divisible by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def accepted(docs: DataFrame, model: Model, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` whose language is known (not `und`) with at least `least_score`."""
    found = identify(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t")), model, "t", keep=["row"])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
