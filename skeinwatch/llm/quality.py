"""Quality rules of texts, and their divergence from how the corpus writes each language.

References are learned first, over all documents that pass the base rules and are not strewn with symbols: by language, the shares of
character classes and of common words (those that make up at least `1 / _COMMON` of the language's
words, so at most `_COMMON`), from the most frequent on pooled into bins of at least `1 / _POOL` of the words:
most common words are not expected once in a text of a few hundred words, so that a bin for each would scatter
as far as a text without any common word lies off. A word seen under `_SEEN` times has no share to go by. Each document is then compared with its language by the
Jensen-Shannon distance of both histograms. Short texts scatter, so a limit is raised by the distance
that a sample of the text's length has by chance, and texts under a minimum length are not judged.

Language names are reduced to two or three ASCII letters, everything else to one group `und`.
That bounds the languages by 26^2 + 26^3 + 1, and with it the references sent to tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import materialize

_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_COMMON = 1000
_POOL = 16
_SEEN = 10
_WINDOW = 5
_FLUSH = 100_000


def _class_table() -> np.ndarray:
    """Classes of UTF-8 bytes: lower, upper, digit, white space, sentence marks, symbols, other ASCII, then lead bytes by length; 10 = inside a character."""
    out = np.full(256, 6, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", _WHITE, b".,;:?'\"()-", _SYMBOLS)):
        out[list(chars)] = k
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 10, 7, 8, 9
    return out


_CLASSES, _N_CLASSES = _class_table(), 10


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8 and its words."""
    inside = sum(map(len, words))
    codes = np.frombuffer(data, np.uint8)
    word_chars = inside - int(np.count_nonzero((codes & 0xC0) == 0x80))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(_WHITE)]
    n_dup_lines = len(lines) - len(set(lines))
    return word_chars, n_symbols, n_dup_lines, repeated_words(words)


def repeated_words(words: list[bytes], width: int = _WINDOW) -> int:
    """Words that lie in some window of `width` words found twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    starts = np.fromiter((seen[g] > 1 for g in grams), np.int64, len(grams))
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(grams)] += starts
    edges[width : width + len(grams)] -= starts
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=11)[:_N_CLASSES]


def language_code(lang: str | None) -> str:
    code = re.split("[-_]", (lang or "").strip().lower())[0]
    return code if re.fullmatch("[a-z]{2,3}", code) else "und"


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 1 against an empty one."""
    if not p.sum() or not q.sum():
        return 0.0 if p.sum() == q.sum() else 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(bits / 2, 0)))


def by_chance(categories: int, n: int) -> float:
    """About the distance that a sample of n has from its own source."""
    return float(np.sqrt(max(categories - 1, 0) / (8 * np.log(2) * max(n, 1))))


@dataclass(frozen=True)
class Limits:
    """A text of fewer words than `min_words` is not compared; a distance beyond a limit plus `slack` times what chance makes rejects."""

    min_words: int = 50
    classes: float = 0.12
    words: float = 0.12
    slack: float = 2.0


@dataclass
class Reference:
    """Of one language: class counts, the bin of each common word, and the counts of bins, that of all other words last."""

    classes: np.ndarray
    number: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def distances(self, data: bytes, words: list[bytes]) -> tuple[float, float]:
        found = Counter(words)
        counts = np.zeros(len(self.words))
        for w in found.keys() & self.number.keys():
            counts[self.number[w]] += found[w]
        counts[-1] = len(words) - counts.sum()
        return js_distance(class_counts(data), self.classes), js_distance(counts, self.words)

    def rejects(self, d_classes: float, d_words: float, n_chars: int, n_words: int, limits: Limits) -> bool:
        if n_words < limits.min_words:
            return False
        of = self.words.sum()
        by_class, by_word = by_chance(_N_CLASSES, n_chars), by_chance(len(self.words), n_words * of / (n_words + of) if of else n_words)
        return d_classes > limits.classes + limits.slack * by_class or d_words > limits.words + limits.slack * by_word


def _split(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode("utf-8")
    return data, data.split()  # bytes: only ASCII white space separates


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, kind (0 class, 1 word), item, n: counts over all documents that pass the base rules and have at most a symbol per ten words."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def out() -> pd.DataFrame:
            rows = [(k, 1, w, n) for k, c in held.items() for w, n in c.items()]
            rows += [(k, 0, bytes([i]), int(n)) for k, v in classes.items() for i, n in enumerate(v)]
            held.clear(), classes.clear()
            return pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])

        for batch in batches:
            for t, k in zip(batch["text"], batch["lang"]):
                data, words = _split(t)
                symbols = len(data) - len(data.translate(None, _SYMBOLS))
                if 10 * symbols > len(words) or base_fails(len(words), repeated_words(words)):
                    continue
                code = language_code(k)
                held.setdefault(code, Counter()).update(words)
                classes[code] = classes.get(code, 0) + class_counts(data)
            if sum(map(len, held.values())) > _FLUSH:
                yield out()
        yield out()

    read = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return read.mapInPandas(partial, "lang string, kind int, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def pooled(words: list[tuple[bytes, int]], total: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Bins of words in their order, each of at least `1 / _POOL` of `total` but the last, and the counts of bins and of all other words."""
    number: dict[bytes, int] = {}
    counts = [0]
    for w, n in words:
        if counts[-1] * _POOL >= total:
            counts.append(0)
        number[w] = len(counts) - 1
        counts[-1] += n
    counts = counts if number else []
    return number, np.array([*counts, total - sum(counts)], float)


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """Histograms of every language. What comes to the driver is bounded by languages x (classes + common words)."""
    counts = materialize(language_counts(docs, text, lang), "language-counts")
    totals = counts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.join(totals, "lang", "left").filter(f"kind = 0 OR (n * {_COMMON} >= total AND n >= {_SEEN} AND length(item) <= 64)")
    out: dict[str, Reference] = {}
    rows = common.collect()
    for r in rows:
        ref = out.setdefault(r["lang"], Reference(np.zeros(_N_CLASSES), {}, np.zeros(1)))
        if r["kind"] == 0:
            ref.classes[r["item"][0]] = r["n"]
    for code, ref in out.items():
        words = sorted(((bytes(r["item"]), r["n"], r["total"]) for r in rows if r["lang"] == code and r["kind"] == 1), key=lambda w: (-w[1], w[0]))
        ref.number, ref.words = pooled([(w, n) for w, n, _ in words], words[0][2] if words else 0)
    return out


def judged(text: Column, lang: Column, references: dict[str, Reference], limits: Limits) -> Column:
    """Struct of the counts, both distances (null where not compared), base_failed and kept."""
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, js_classes double, js_words double, base_failed boolean, kept boolean"
    names = [c.split()[0] for c in kind.split(", ")]

    @F.pandas_udf(kind)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs in batches:
            rows = []
            for t, k in zip(texts, langs):
                data, words = _split(t)
                counts = base_counts(data, words)
                failed = base_fails(len(words), counts[3])
                ref, d, rejected = references.get(language_code(k)), (None, None), False
                if ref is not None and len(words) >= limits.min_words:
                    d = ref.distances(data, words)
                    rejected = ref.rejects(*d, len(t), len(words), limits)
                rows.append((len(words), *counts, *d, failed, not failed and not rejected))
            yield pd.DataFrame(rows, columns=names).astype({"js_classes": "float64", "js_words": "float64"})

    return judge(text, lang)


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, js_classes, js_words, base_failed and kept.

    Null and empty texts have zero counts and fail the base rules. A null or unknown language is the
    group `und`; a language none of whose documents passes the base rules has no reference and is not compared.
    Repeated rows each have their result. Columns of these names are replaced; all others stay.
    """
    references = learn_references(docs, text, lang)
    found = docs.withColumn("_judged", judged(F.coalesce(F.col(text), F.lit("")), F.col(lang), references, limits))
    names = found.schema["_judged"].dataType.names
    return found.withColumns({n: F.col(f"_judged.{n}") for n in names}).drop("_judged")
