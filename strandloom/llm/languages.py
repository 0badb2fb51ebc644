"""Problem 9: languages of documents and segments by nearest TF-IDF n-gram centroids with rejection."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.storage import spread

#: Buckets of hashed letter n-grams; their lengths; weight of a word's script among them; centroids
#: per language.
BUCKETS, LENGTHS, SCRIPT, CENTROIDS = 4096, (1, 2, 3), 2, 3
#: Labelled documents per language, paragraphs per document and characters per paragraph that
#: train the centroids; they bound what the driver gathers.
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS, SAMPLE_CHARACTERS = 80, 10, 4000
#: Least share of a language's paragraphs in a cluster; a smaller one holds strays.
LEAST_CLUSTER = 0.02
#: Cosines are taken as shares of what TYPICAL of a language's training paragraphs exceed. A
#: paragraph is rejected if that share times its lead over the next language (at most MOST_LEAD)
#: is below REJECT, or if it leads by less than LEAD with a share below SURE.
TYPICAL, REJECT, MOST_LEAD, LEAD, SURE = 0.95, 0.515, 1.5, 1.055, 0.54
#: Scale of cosines in the confidence.
SHARPNESS = 25.0
#: Sentences from which a paragraph can give its document a language.
LEAST_SENTENCES = 2
#: What a label may call each language.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german",
    "fr": "fr fra fre french",
    "es": "es spa spanish castilian",
    "pt": "pt por portuguese",
    "it": "it ita italian",
    "ru": "ru rus russian",
    "uk": "uk ukr ukrainian",
    "zh": "zh zho chi chinese mandarin",
}

_COMMENT = re.compile(r"(?<!\\)%.*(?:\n(?![^\S\n]*\n))?")
_SKIPPED_NAMES = r"(comment|figure|table|tabular|equation|align|gather|multline|eqnarray|displaymath|math|verbatim|lstlisting|thebibliography)(\*?)"
_SKIPPED = re.compile(rf"\\begin\{{{_SKIPPED_NAMES}\}}(?:(?!\\begin\{{\1\2\}}).)*?\\end\{{\1\2\}}", re.DOTALL)
_UNCLOSED = re.compile(rf"\\begin\{{{_SKIPPED_NAMES}\}}.*?(?=\n\s*\n|\Z)", re.DOTALL)
_LINE = r"\n(?![^\S\n]*\n)"  # a line break that does not end the paragraph
_MATH = re.compile(rf"\$\$(?:[^$\n]|{_LINE})*\$\$|\\\[(?:[^\\\n]|\\(?!\])|{_LINE})*\\\]|\\\((?:[^\\\n]|\\(?!\))|{_LINE})*\\\)|(?<!\\)\$(?:[^$\n]|{_LINE})*\$")
_HEAD = re.compile(r"\\(?:(?:sub)*section|paragraph|chapter|part|title|author|date|caption)\*?\s*(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}")
_POINTER = re.compile(r"~?\\(?:label|cite[tp]?|ref|eqref|input|include|includegraphics|bibliography|bibliographystyle|usepackage|foreignlanguage|selectlanguage)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?")
_ACCENT = re.compile(r"\\([\"'`^~=.])\s*\{?\\?([A-Za-z])\}?|\\([cvukHr])(?:\{\\?([A-Za-z])\}|\s+([A-Za-z]))")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?|\\[^a-zA-Z]|[{}~]")
_BREAK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[.!?]+(?=[\s\"'»”)\]]|$)|[。！？]")
_TOKEN = re.compile(r"[\u3040-\u9fff]|[^\W\d_\u3040-\u9fff]+")
#: Combining marks of accent commands.
_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "k": "\u0328", "H": "\u030b", "r": "\u030a"}


def _accented(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m[2] or m[4] or m[5]) + _MARKS[m[1] or m[3]])


def running_paragraphs(source: str) -> list[str]:
    """Paragraphs of the abstract, sections and quotations of an article's source, without
    comments, floats, formulas, headings, bibliography and markup; accent commands are letters. A
    float or formula without its end goes as far as its paragraph."""
    if (a := source.find("\\begin{document}")) >= 0:
        b = source.find("\\end{document}", a)
        source = source[a + 16 : b if b >= 0 else len(source)]
    if "%" in source:
        source = _COMMENT.sub("", source)
    if "\\" in source:
        text = _MATH.sub(" ", _UNCLOSED.sub(" ", _SKIPPED.sub(" ", source)))
        text = _ENVIRONMENT.sub("\n\n", _HEAD.sub("\n\n", _POINTER.sub("", text)))
        text = _ACCENT.sub(_accented, text.replace("\\ss", "ß"))
        source = _COMMAND.sub(" ", text)
    else:
        source = _MATH.sub(" ", source)
    return [p for p in _BREAK.split(source) if p.strip()]


def _script(letter: str) -> str:
    """Writing of a word's first letter: ideographs, kana, or the alphabet by its block."""
    o = ord(letter)
    return "ideograph" if 0x4E00 <= o <= 0x9FFF else "kana" if 0x3040 <= o <= 0x30FF else "latin" if o < 0x250 else f"block {o >> 8}"


def word_grams(word: str) -> list[str]:
    """n-grams of a word between marks, with their lengths, and its script SCRIPT times."""
    padded = f"_{word}_"
    grams = [f"{n}{padded[i : i + n]}" for n in LENGTHS for i in range(len(padded) - n + 1)]
    return [g for g in grams if g != "1_"] + [_script(word[0])] * SCRIPT


class Grams:
    """Words as numbers of hashed n-grams, remembered per task."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.features: list[np.ndarray] = []

    def __call__(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.features)
            self.features.append(np.array([zlib.crc32(g.encode()) % BUCKETS for g in word_grams(word)], np.int32))
        return n

    def counts(self, paragraphs: list[str]) -> np.ndarray:
        """Square roots of n-gram counts, one row per paragraph."""
        if len(self.features) > self.most:
            self.clear()
        words = [_TOKEN.findall(p.lower()) for p in paragraphs]
        sizes = [len(w) for w in words]
        numbers = np.fromiter((self(x) for w in words for x in w), np.int64, sum(sizes))
        if not len(numbers):
            return np.zeros((len(paragraphs), BUCKETS), np.float32)
        used, at = np.unique(numbers, return_inverse=True)
        features = [self.features[i] for i in used.tolist()]
        lengths = np.array([len(f) for f in features])
        flat, start = np.concatenate(features), np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(paragraphs)), sizes)
        each = lengths[at]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        cell = np.repeat(of * BUCKETS, each) + flat[np.repeat(start[at], each) + k]
        return np.sqrt(np.bincount(cell, minlength=len(paragraphs) * BUCKETS).reshape(len(paragraphs), BUCKETS).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Languages' centroids; typical is the cosine that TYPICAL of a language's paragraphs exceed."""

    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    typical: np.ndarray
    languages: list[str]

    def classify(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1 if rejected) and confidence of each row of counts.

        Distance rejects relative to how near the language's own paragraphs are: a text on topics
        unknown to the training is less typical than those, yet far nearer to its language than to
        the others; one in a language of none of the centroids lies between two or far from all.
        """
        n = len(self.languages)
        if not n:
            return np.full(len(counts), -1), np.zeros(len(counts))
        score = _unit(counts * self.idf) @ self.centroids.T
        best = np.stack([score[:, self.of == i].max(axis=1) for i in range(n)], axis=1)
        order = np.argsort(best, axis=1)
        top = order[:, -1]
        first = best[np.arange(len(best)), top]
        second = best[np.arange(len(best)), order[:, -2]] if n > 1 else np.zeros(len(best))
        share = first / np.maximum(self.typical[top], 1e-9)
        lead = first / np.maximum(second, 1e-9)
        lang = np.where((share * np.minimum(lead, MOST_LEAD) >= REJECT) & ((share >= SURE) | (lead >= LEAD)), top, -1)
        e = np.exp(SHARPNESS * (best - first[:, None]))
        return lang, np.where(lang >= 0, 1 / e.sum(axis=1), 0.0)


def train(counts: np.ndarray, labels: list[str]) -> Model:
    """Centroids from counted paragraphs with their documents' labels.

    Labels may be wrong for some: with one mean vector per language, paragraphs nearer to
    another language's are set aside, a few times over, before each language's rest is
    clustered by spherical k-means.
    """
    names = sorted(set(labels))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x, y = _unit(counts * idf), np.array([names.index(v) for v in labels], np.int64)
    keep = counts.any(axis=1) if len(counts) else np.zeros(0, bool)
    for _ in range(5):
        means = np.stack([_unit(x[keep & (y == i)].sum(axis=0)) for i in range(len(names))]) if names else np.zeros((0, BUCKETS))
        if names:
            keep = counts.any(axis=1) & ((x @ means.T).argmax(axis=1) == y)
    centroids, of, typical, known = [], [], [], []
    for i in range(len(names)):
        own = x[keep & (y == i)]
        if not len(own):
            continue
        c = own[[0]]
        while len(c) < min(CENTROIDS, len(own)):
            c = np.r_[c, own[[(own @ c.T).max(axis=1).argmin()]]]
        for _ in range(10):
            near = (own @ c.T).argmax(axis=1)
            c = np.stack([_unit(own[near == k].sum(axis=0)) if (near == k).any() else c[k] for k in range(len(c))])
        cosine = own @ c.T
        near = cosine.argmax(axis=1)
        large = [k for k in range(len(c)) if (near == k).mean() >= LEAST_CLUSTER]
        centroids += [c[k] for k in large]
        of += [len(known)] * len(large)
        typical.append(np.quantile(cosine[:, large].max(axis=1), 1 - TYPICAL))
        known.append(names[i])
    return Model(idf, np.array(centroids, np.float32).reshape(-1, BUCKETS), np.array(of, np.int64), np.array(typical), known)


def label_language(label: Column) -> Column:
    """Two-letter code of a label in any notation (code, locale, English name, any letter case);
    null for missing, undetermined and unknown ones."""
    names = F.create_map(*(F.lit(x) for code, all_of in NAMES.items() for name in all_of.split() for x in (name, code)))
    return F.try_element_at(names, F.split(F.lower(F.trim(label)), "[-_ ]").getItem(0))


def _sample(documents: DataFrame) -> tuple[np.ndarray, list[str]]:
    labelled = documents.select("doc_id", label_language(F.col("lang")).alias("label")).filter("label IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.withColumn("n", rank).filter(F.col("n") <= SAMPLE_DOCUMENTS).select("doc_id").collect()
    some = documents.filter(F.col("doc_id").isin([r["doc_id"] for r in chosen])).select(label_language(F.col("lang")).alias("label"), "text").filter("label IS NOT NULL AND text IS NOT NULL")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(label, p[:SAMPLE_CHARACTERS]) for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in running_paragraphs(t)[:SAMPLE_PARAGRAPHS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["label", "paragraph"])

    rows = sorted((r["label"], r["paragraph"]) for r in some.mapInArrow(cut_up, "label string, paragraph string").collect())
    return Grams().counts([p for _, p in rows]), [label for label, _ in rows]


def fit(documents: DataFrame) -> Model:
    """A model from at most SAMPLE_DOCUMENTS labelled documents per language, chosen by a hash of
    doc_id, and SAMPLE_PARAGRAPHS paragraphs of SAMPLE_CHARACTERS each. Only fitting is bounded."""
    return train(*_sample(documents))


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, segment, first_paragraph, n_paragraphs, lang, confidence, n_characters, most_sentences``.

    Every paragraph of running text goes to the language of its nearest centroid, or to none
    (lang null, confidence 0) if it is too far from it; a segment is a run of paragraphs with
    the same outcome. confidence is the mean of its paragraphs' confidences weighted by
    characters; most_sentences is of its paragraph with most sentences. A document without text
    or without running text has no segments. Whole texts are read; nothing is shuffled.
    """
    kind = "doc_id long, segment int, first_paragraph int, n_paragraphs int, lang string, confidence double, n_characters long, most_sentences int"
    names = [x.split()[0] for x in kind.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, b.num_rows, 32):
                found = [running_paragraphs(t) if t else [] for t in texts.slice(lo, 32).to_pylist()]
                flat = [p for ps in found for p in ps]
                lang, sure = [], []
                for i in range(0, len(flat), 256):
                    la, su = model.classify(grams.counts(flat[i : i + 256]))
                    lang += la.tolist()
                    sure += su.tolist()
                out, i = [], 0
                for d, ps in zip(ids[lo : lo + 32], found):
                    first = i
                    end, n = i + len(ps), 0
                    while i < end:
                        j = i
                        while j < end and lang[j] == lang[i]:
                            j += 1
                        sizes = [len(p) for p in flat[i:j]]
                        mean = sum(s * c for s, c in zip(sizes, sure[i:j])) / sum(sizes)
                        sentences = max(len(_SENTENCE.findall(p)) for p in flat[i:j])
                        out.append((d, n, i - first, j - i, model.languages[lang[i]] if lang[i] >= 0 else None, mean, sum(sizes), sentences))
                        n, i = n + 1, j
                columns = list(zip(*out)) or [()] * len(names)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(make, kind)


def document_languages(found: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence, n_languages`` from segments: the language with most characters,
    its share of the characters times its mean confidence, and the number of languages. Ties go
    to the greater code; documents with rejected segments only have null and 0."""
    by = found.groupBy("doc_id", "lang").agg(F.sum("n_characters").alias("n"), F.sum(F.col("confidence") * F.col("n_characters")).alias("c"))
    best = F.max(F.when(F.col("lang").isNotNull(), F.struct("n", "lang", "c"))).alias("best")
    return by.groupBy("doc_id").agg(best, F.sum("n").alias("all"), F.count("lang").alias("n_languages")).select(
        "doc_id", F.col("best.lang").alias("lang"), F.coalesce(F.col("best.c") / F.col("all"), F.lit(0.0)).alias("confidence"), "n_languages"
    )


def mislabelled(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, lang``: languages of paragraphs of LEAST_SENTENCES sentences that the document's
    label does not name."""
    used = found.filter(F.col("lang").isNotNull() & (F.col("most_sentences") >= LEAST_SENTENCES)).select("doc_id", "lang").distinct()
    labels = documents.select(F.col("doc_id").cast("long").alias("doc_id"), label_language(F.col("lang")).alias("label"))
    return used.join(labels, "doc_id").filter(~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", "lang")
