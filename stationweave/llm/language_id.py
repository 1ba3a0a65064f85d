"""Language identification in two steps: the family first, then the language within it.

A text is its distribution over hashed byte grams of several sizes, square roots taken. Linear
support vector machines, one for each pair of families and of languages of one family, are fitted
on a bounded sample of labelled texts; every text is then predicted from its whole length.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import any_names, as_bytes, lists, modest_batches, settle, small

# Families of common languages by code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it la lmo oc pms pt ro sc scn",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "ckb fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su",
    "sinitic": "wuu yue zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Bytes as they count: A-Z lower-cased, all other ASCII but letters a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTERS = bytes(range(97, 123))


@dataclass(frozen=True)
class LanguageModel:
    """sizes: bytes of a gram. buckets: hashed grams of each size. per_language: the most texts of a
    language that are fitted on, the bound of the sample. rounds and penalty: of the fit."""

    sizes: tuple[int, ...] = (1, 2, 3, 4)
    buckets: int = 2048
    per_language: int = 300
    rounds: int = 100
    penalty: float = 1e-4


def has_letter(text: bytes) -> bool:
    folded = text.translate(_FOLD)
    if len(folded.translate(None, _ASCII_LETTERS)) < len(folded):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(text: bytes, rules: LanguageModel) -> np.ndarray:
    """Square roots of the shares of each bucket, sizes one after another."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    raw = np.frombuffer(folded, np.uint8).astype(np.uint32)
    found = np.zeros(len(rules.sizes) * rules.buckets, np.float32)
    gram = np.zeros(len(raw), np.uint32)
    done = 0
    for i, size in enumerate(rules.sizes):
        while done < size:
            gram = (gram[: len(raw) - done] << np.uint32(8)) | raw[done:]
            done += 1
        if len(gram):
            at = ((gram * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(rules.buckets)
            found[i * rules.buckets : (i + 1) * rules.buckets] = np.sqrt(np.bincount(at, minlength=rules.buckets) / len(gram))
    return found


def fit_svm(x: np.ndarray, y: np.ndarray, rules: LanguageModel) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps. y is 1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    used = np.flatnonzero(x.any(0))
    part = np.ascontiguousarray(x[:, used])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = np.float32(1.0 / (2 * float((part * part).sum(1).max()) + rules.penalty))
    w = before = np.zeros(part.shape[1], np.float32)
    for k in range(rules.rounds):
        at = w + np.float32(k / (k + 3)) * (w - before)
        slack = np.maximum(np.float32(0), 1 - y * (part @ at))
        before, w = w, at - step * (np.float32(rules.penalty) * at - 2 * ((share * slack * y) @ part))
    whole = np.zeros(x.shape[1], np.float32)
    whole[used] = w
    return whole


class Predictor:
    """Machines for pairs of families, and for pairs of languages of one family."""

    def __init__(self, languages: list[str], x: np.ndarray, rules: LanguageModel):
        self.rules = rules
        y = np.array(languages, object)
        family = np.array([FAMILY_OF.get(code.lower(), code) for code in languages], object)
        self.families = sorted(set(family))
        self.members = {f: sorted(set(y[family == f])) for f in self.families}
        groups = [(self.families, family)] + [(m, y) for m in self.members.values()]
        self.pairs = [(a, b, labels) for names, labels in groups for a, b in combinations(names, 2)]
        fitted = []
        for a, b, labels in self.pairs:
            of = (labels == a) | (labels == b)
            fitted.append(fit_svm(x[of], np.where(labels[of] == a, 1.0, -1.0), rules))
        width = len(rules.sizes) * rules.buckets
        whole = np.array(fitted).reshape(len(fitted), width + 1)
        self.weights, self.bias = whole[:, :width].astype(np.float32), whole[:, width]
        self.place = {(a, b, labels is family): i for i, (a, b, labels) in enumerate(self.pairs)}
        del self.pairs

    def _vote(self, names: list[str], of_families: bool, margins: np.ndarray) -> tuple[str, float]:
        """The name that wins most duels (ties: by margins, then the first), and its mean chance in them."""
        wins = {n: [0, 0.0, 0.0] for n in names}
        for a, b in combinations(names, 2):
            m = float(margins[self.place[a, b, of_families]])
            chance = 1 / (1 + np.exp(-4 * min(20.0, max(-20.0, m))))
            for n, good, p in ((a, m >= 0, chance), (b, m < 0, 1 - chance)):
                wins[n][0] += good
                wins[n][1] += m if n == a else -m
                wins[n][2] += p
        best = max(names, key=lambda n: (wins[n][0], wins[n][1]))
        return best, wins[best][2] / (len(names) - 1) if len(names) > 1 else 1.0

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        margins = self.weights @ features(text, self.rules) + self.bias
        family, sure = self._vote(self.families, True, margins)
        language, chance = self._vote(self.members[family], False, margins)
        return language, float(sure * chance)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rules: LanguageModel = LanguageModel()) -> Predictor:
    """Fit on at most rules.per_language texts of each language, those with the least hashes of their
    texts. Rows without language or without a letter are left out; equal texts of a language count once.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), as_bytes(text).alias("text"))
    # Different texts are counted, or many copies of some would leave few or none of the others.
    counts, _ = small(labelled.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count())
    # A first cut by hash leaves about twice the sample, so that no language meets in one task.
    numbered = labelled.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    cut = numbered.join(counts, "lang").where(F.col("h") * F.col("count") <= (2.0 * rules.per_language + 100) * (1 << 30)).select("lang", "h", "text").distinct()
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = cut.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rules.per_language)

    @F.arrow_udf(T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))]))
    def sparse(texts: pa.Array) -> pa.Array:
        at, x, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
        for value in texts.to_pylist():
            found = features(value, rules) if has_letter(value) else np.zeros(1, np.float32)
            at.append(np.flatnonzero(found).astype(np.int32))
            x.append(found[at[-1]])
            sizes.append(len(x[-1]))
        sizes = np.array(sizes, np.int64)
        return pa.StructArray.from_arrays([lists(np.concatenate(at), sizes, pa.int32()), lists(np.concatenate(x), sizes, pa.float32())], names=["at", "x"])

    rows = settle(sample.select("lang", "h", sparse("text").alias("s"))).where(F.size("s.at") > 0).orderBy("lang", "h").collect()
    x = np.zeros((len(rows), len(rules.sizes) * rules.buckets), np.float32)
    for i, row in enumerate(rows):
        x[i, row["s"]["at"]] = row["s"]["x"]
    return Predictor([row["lang"] for row in rows], x, rules)


@any_names
def predict(docs: DataFrame, model: Predictor, text: str = "text") -> DataFrame:
    """All columns, with lang_pred (string) and score (double, 0 to 1) added or replaced.

    Nothing but the text is looked at. A null text, or one without a letter, is `und` with score 0, as
    is every text under a model that was fitted on nothing. Repeated rows are predicted alike; an empty
    table stays empty. A model with one language always says that language.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(value) for value in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([l for l, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang_pred", "score"])

    kept = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score", "_found")]
    return docs.withColumn("_found", predicted(as_bytes(text))).select(*kept, "_found.lang_pred", "_found.score")
