"""Quality rules by distribution divergence.

Every language of the table gets a reference: how its bytes spread over character classes, and how
often its common words occur. Both are counted over all documents. A document is compared with the
reference of its language by the Jensen-Shannon distance; one that is too far off is rejected, as
is one that fails the plain rules on length and repeated words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import any_names, as_bytes, modest_batches, settle

# Deletions that leave what a figure counts.
_SPACES_AND_TAILS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

# Character classes of a byte.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "point", "symbol", "other")


def _class_table() -> np.ndarray:
    of = np.full(256, CLASSES.index("symbol"), np.uint8)
    of[list(b"abcdefghijklmnopqrstuvwxyz")] = CLASSES.index("consonant")
    of[list(b"aeiou")] = CLASSES.index("vowel")
    of[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = CLASSES.index("upper")
    of[list(b"0123456789")] = CLASSES.index("digit")
    of[list(b" \t\n\v\f\r")] = CLASSES.index("space")
    of[list(b".,;:?'\"()-")] = CLASSES.index("point")
    of[128:] = CLASSES.index("other")
    return of


_CLASS_OF = _class_table()


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules.

    min_words, max_repeat_pct: the plain rules. guard_words: shorter documents are not compared,
    their histograms say too little. class_distance, word_distance: (limit, allowance); a document
    of n words may be off by limit + allowance / sqrt(n) in Jensen-Shannon distance (0 to 1), since
    short texts stray from any reference by chance. common_share: a word is common if it is at least this share of its language's
    words, so a language has at most 1 / common_share of them. reference_words: a language has a
    reference if it holds at least so many words, whatever its share of all.
    """

    min_words: int = 10
    max_repeat_pct: int = 20
    guard_words: int = 50
    class_distance: tuple[float, float] = (0.25, 0.8)
    word_distance: tuple[float, float] = (0.22, 1.2)
    common_share: float = 0.004
    reference_words: int = 2500


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(CLASSES))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == len(words):
        return 0
    number = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    # Windows as numbers: pairs of numbers are renumbered without gaps, so nothing can collide.
    window, width = number, 1
    while width < size:
        step = min(width, size - width)
        pair = window[: len(window) - step] * (int(window.max()) + 1) + window[step:]
        width += step
        distinct, window = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
    hit = (np.bincount(window)[window] > 1).astype(np.int8)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(seen) - len(set(seen))


_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance with logarithms to base 2; 0 if either side has no mass."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2

    def divergence(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / m[some])).sum())

    return max(0.0, (divergence(p) + divergence(q)) / 2) ** 0.5


def references(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> list[dict]:
    """Per language its class counts and its common words with their counts, from all documents.

    Rows without language count for none. For every language of at least reference_words words, at most
    1 / common_share of them come to the driver, whatever the table's size.
    """

    def counted(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            classes: dict[str, np.ndarray] = {}
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(language, Counter()).update(value.lower().split())
                classes[language] = classes.get(language, 0) + class_counts(value)
            rows = [(language, 0, w, n) for language, c in words.items() for w, n in c.items()]
            rows += [(language, 1, name.encode(), int(n)) for language, c in classes.items() for name, n in zip(CLASSES, c)]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], names=["lang", "kind", "item", "n"])

    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), as_bytes(text).alias("value"))
    counts = settle(rows.mapInArrow(counted, "lang string, kind int, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    sizes = counts.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= rules.reference_words)
    found = counts.join(sizes, "lang").where(f"kind = 1 or n >= {rules.common_share} * total").collect()
    out: dict[str, dict] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["kind"], bytes(r["item"]))):
        reference = out.setdefault(row["lang"], {"lang": row["lang"], "total": row["total"], "words": [], "counts": [], "classes": [0] * len(CLASSES)})
        if row["kind"]:
            reference["classes"][CLASSES.index(bytes(row["item"]).decode())] = row["n"]
        else:
            reference["words"].append(bytes(row["item"]))
            reference["counts"].append(row["n"])
    return list(out.values())


class _Judge:
    def __init__(self, known: list[dict], rules: QualityRules):
        self.rules = rules
        self.of = {}
        for r in known:
            rest = r["total"] - sum(r["counts"])
            self.of[r["lang"]] = {w: i for i, w in enumerate(r["words"])}, np.array([*r["counts"], rest], float), np.array(r["classes"], float)

    def one(self, value: bytes, language: str | None) -> tuple:
        words = value.split()
        n, rules = len(words), self.rules
        repeat = repeated_words(words)
        failed = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
        nearest, near = (0.0, 0.0), True
        if n >= rules.guard_words and self.of and (language is None or language in self.of):
            counts, classes = Counter(value.lower().split()), class_counts(value).astype(float)
            limits = [limit + allowance / n**0.5 for limit, allowance in (rules.class_distance, rules.word_distance)]
            distances = []
            for place, reference, of_classes in [self.of[language]] if language is not None else self.of.values():
                own = np.array([counts.get(w, 0) for w in place] + [0.0])
                own[-1] = n - own.sum()
                distances.append((_distance(classes, of_classes), _distance(own, reference)))
            nearest = min(distances, key=lambda d: max(d[0] / limits[0], d[1] / limits[1]))
            near = nearest[0] <= limits[0] and nearest[1] <= limits[1]
        good = near and not failed
        return n, len(value.translate(None, _SPACES_AND_TAILS)), len(value) - len(value.translate(None, _SYMBOLS)), duplicate_lines(value), repeat, *nearest, failed, good


@any_names
def judge(df: DataFrame, rules: QualityRules = QualityRules(), known: list[dict] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns, with statistics, distances and verdict added or replaced.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); class_distance and
    word_distance (double; 0 for documents under guard_words); base_failed; kept. known are the
    references, by default those of the table itself. A document without language is held against its
    nearest reference. For a language without reference, and without any references, only the plain
    rules decide. Null and empty texts have no words and fail. Repeated rows are judged alike,
    an empty table stays empty.
    """
    modest_batches(df.sparkSession)
    known = references(df, rules, text, lang) if known is None else known
    shared = df.sparkSession.sparkContext.broadcast(known)
    added = [*_STATISTICS, "class_distance", "word_distance", "base_failed", "kept"]
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
    schema = ", ".join(f"{c}: {k}" for c, k in zip(added, ["long"] * 5 + ["double"] * 2 + ["boolean"] * 2))

    @F.arrow_udf(f"struct<{schema}>")
    def judged(texts: pa.Array, langs: pa.Array) -> pa.Array:
        one = _Judge(shared.value, rules).one
        rows = [one(v, x) for v, x in zip(texts.to_pylist(), langs.to_pylist())]
        columns = list(zip(*rows)) or [()] * len(added)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=added)

    others = [f"`{c}`" for c in df.columns if c not in added and c != "_judged"]
    return df.withColumn("_judged", judged(as_bytes(text), F.col(lang).cast("string"))).select(*others, "_judged.*")
