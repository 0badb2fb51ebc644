"""Problem 8: evaluation passages inside corpus texts, by joined windows of canonical templates."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.storage import spread

#: Words of a template window, and how many of them must not be placeholders.
WINDOW, LEAST_PLAIN = 4, 2
#: Words a chain of windows may skip on either side, and by how much the skips may differ.
GAP, DRIFT = 14, 9
#: Windows a document and an item must share to be aligned, and words of a leak.
LEAST_SHARED, LEAST_RUN = 6, 18
#: Words of a verbatim leak, and how often an otherwise filled placeholder counts against its equal
#: words where most placeholders are: other items of the same template differ in numbers and names.
LEAST_SAME, SLOT_COST = 20, 2
#: Characters of the evaluation items that tasks hold at a time; more are asked in blocks.
BLOCK_CHARS = 1 << 26
#: Bits of the prefilter for every item window, and the least and most of it as powers of two.
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 16, 16, 30
NAME, NUMBER, UNIT, FIRST_WORD = 0, 1, 2, 3
#: Unit symbols and names that stand for any unit.
UNITS = frozenset("mm cm m km mg g kg t ms s min h hz khz mhz ghz w kw v kv k pa kpa mpa ml l nm um percent degrees metres meters kilometres kilometers grams kilograms tonnes litres liters seconds minutes hours miles pounds ounces inches feet".split())

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"\\[a-zA-Z]+\*?|\\[^a-zA-Z\s]")
_NOTE = re.compile(r"\\(?:footnote|thanks|cite[tp]?|ref|label|marginpar)\*?\s*\{[^{}]{0,40}\}", re.IGNORECASE)
_ODD = re.compile("[\u00ad\ufb00-\ufb06\u200b-\u200d\uff01-\uff5e]")


def plain_words(text: str) -> list[str]:
    """Words of a source text in lower case: markup commands and short notes are dropped, comment
    signs, braces, quotes and dashes separate words, ligatures and wide letters are plain."""
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", text.replace("\u00ad", ""))
    if "\\" in text:
        text = _MARKUP.sub(" ", _NOTE.sub(" ", text))
    return _WORD.findall(text.lower())


class Lexicon(dict):
    """Numbers of the items' plain words; other words are typed placeholders."""

    units: frozenset = UNITS

    def __missing__(self, word: str) -> int:
        return NUMBER if word[0].isdigit() or word.isnumeric() else UNIT if word in self.units else NAME


def lexicon(texts: list[str], units: frozenset = UNITS) -> Lexicon:
    """Words of the items but for numbers, ``units`` and names (words that are capitalised within a
    sentence and never in lower case)."""
    small, names = set(), set()
    for text in texts:
        for m in re.finditer(r"[^\W_]+", text):
            word = m.group()
            if word == word.lower():
                small.add(word)
            elif m.start() and not re.search(r"(?:^|[.?!:]\W*|\n\s*\n\s*)$", text[max(0, m.start() - 4) : m.start()]):
                names.add(word.lower())
    every = {w for t in texts for w in plain_words(t)}
    kept = sorted(w for w in every if not (w[0].isdigit() or w.isnumeric() or w in units or (w in names and w not in small)))
    found = Lexicon({w: FIRST_WORD + i for i, w in enumerate(kept)})
    found.units = units
    return found


def template_windows(words: list[list[str]], known: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and 64-bit hash of every window with LEAST_PLAIN plain words."""
    sizes = np.array([len(w) for w in words], np.int64)
    get = known.__getitem__
    ids = np.fromiter((get(x) for w in words for x in w), np.int64, int(sizes.sum()))
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(words)), sizes)
    plain = np.r_[0, np.cumsum(ids >= FIRST_WORD)]
    at = np.flatnonzero((plain[WINDOW:] - plain[:-WINDOW] >= LEAST_PLAIN) & (text[:n] == text[WINDOW - 1 :]))
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            h = (h + ids[at + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    start = np.r_[0, np.cumsum(sizes)]
    return text[at], at - start[text[at]], h.view(np.int64)


def _bit(h: np.ndarray, power: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)


def _windows(table: DataFrame, key: str, known: Lexicon, bits: np.ndarray | None) -> DataFrame:
    """``key, at, h, words`` of the texts' template windows; with ``bits``, of those that may occur in an item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, power = (None, 0) if bits is None else (np.unpackbits(bits).view(bool), (len(bits) * 8).bit_length() - 1)
        for b in batches:
            keys = b.column(0)
            for lo in range(0, b.num_rows, 256):
                words = [plain_words(t) if t else [] for t in b.column(1).slice(lo, 256).to_pylist()]
                text, at, h = template_windows(words, known)
                if allowed is not None:
                    keep = allowed[_bit(h, power)]
                    text, at, h = text[keep], at[keep], h[keep]
                raw = [" ".join(words[t][a : a + WINDOW]) for t, a in zip(text.tolist(), at.tolist())]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(lo + text)), pa.array(at, pa.int32()), pa.array(h), pa.array(raw, pa.string())], names=[key, "at", "h", "words"])

    return spread(table.select(F.col(key).cast("long"), "text")).mapInArrow(make, f"{key} long, at int, h long, words string")


def align(at: np.ndarray, item_at: np.ndarray) -> list[int]:
    """Indices of the chain of shared windows that covers most item words in order, with at most
    GAP words skipped on either side between neighbours. Windows come sorted by ``at, item_at``."""
    best, back = np.full(len(at), WINDOW), np.full(len(at), -1)
    lo = np.searchsorted(at, at - GAP - WINDOW, "left")
    hi = np.searchsorted(at, at, "left")
    for i in range(len(at)):
        a, b = lo[i], hi[i]
        if a == b:
            continue
        d, e = at[i] - at[a:b], item_at[i] - item_at[a:b]
        ok = (e > 0) & (e <= GAP + WINDOW) & (np.abs(d - e) <= DRIFT)
        if ok.any():
            score = np.where(ok, best[a:b] + np.minimum(WINDOW, e), -1)
            k = int(score.argmax())
            if score[k] > best[i]:
                best[i], back[i] = score[k], a + k
    i, chain = int(best.argmax()), []
    while i >= 0:
        chain.append(i)
        i = int(back[i])
    return chain[::-1]


def _compare(at, item_at, words, item_words, known: Lexicon) -> tuple[int, int, int, int, int, bool]:
    order = np.lexsort((item_at, at))
    chain = [int(order[i]) for i in align(at[order], item_at[order])]
    pairs: dict[int, tuple[str, str]] = {}
    for i in chain:
        for k, (x, y) in enumerate(zip(item_words[i].split(" "), words[i].split(" "))):
            if pairs.get(item_at[i] + k, ("", " "))[0] != pairs.get(item_at[i] + k, ("", " "))[1]:
                pairs[item_at[i] + k] = (x, y)
    slots = [(x, y) for x, y in pairs.values() if known[x] < FIRST_WORD]
    filled: dict[str, set] = {}
    for x, y in slots:
        filled.setdefault(x, set()).add(y)
    consistent = all(len(v) == 1 for v in filled.values())
    bridged = int((np.diff(sorted(pairs)) == 2).sum())
    return len(pairs), bridged, sum(x == y for x, y in pairs.values()), len(slots), sum(x != y for x, y in slots), consistent


def verbatim() -> Column:
    """Whether a row of leaks() is the item's own passage rather than its template filled anew: a run
    of LEAST_SAME words, single changed or missing ones counted, of whose placeholders at least
    half are filled as in the item; or so many equal words that the changed ones do not matter."""
    own = (F.col("run_words") + F.col("n_bridged") >= LEAST_SAME) & (2 * F.col("n_slots_changed") <= F.col("n_slots"))
    return own | (F.col("same_words") - SLOT_COST * F.col("n_slots_changed") >= LEAST_SAME)


def leaks(documents: DataFrame, items: DataFrame, units: frozenset = UNITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, run_words, n_bridged, same_words, n_slots, n_slots_changed, consistent``:
    documents and items that share a run of template windows.

    Numbers, units and names of the items are typed placeholders, other unknown words of a
    document are names; windows of WINDOW placeholders and words are joined by hash, and the
    shared windows of a pair are chained in order over short insertions and losses. run_words
    counts the item words of the best chain, n_bridged the single item words it passes over,
    same_words those whose raw words are equal, n_slots_changed the placeholders filled
    otherwise; consistent says that equal fillings of the item have equal fillings in the
    document. Only runs of LEAST_RUN words, bridged ones included, are kept.

    Null and empty texts share nothing; repeated items and documents are rows of their own.
    Extra columns are ignored. Whole texts are read. Every task holds the items' words and a
    bitmap of their windows, through which only windows that may match leave a document. Items of
    more than ``block_chars`` characters are asked in several blocks, each of which reads the
    documents; what is a name is then decided within a block.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 if chars <= block_chars else math.ceil(2 * chars / block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [_leaks(documents, items if blocks == 1 else items.filter(block == k), units) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _leaks(documents: DataFrame, items: DataFrame, units: frozenset) -> DataFrame:
    texts = [r["text"] for r in items.select("text").filter("text IS NOT NULL").collect()]
    known = lexicon(texts, units)
    windows = template_windows([plain_words(t) for t in texts], known)[2]
    power = min(MOST_BITS, max(LEAST_BITS, (len(windows) * BITS_A_WINDOW).bit_length()))
    bits = np.zeros(1 << power, bool)
    bits[_bit(windows, power)] = True
    asked = _windows(items, "item_id", known, None).withColumnsRenamed({"at": "item_at", "words": "item_words"})
    held = _windows(documents, "doc_id", known, np.packbits(bits))
    shared = held.join(asked, "h").groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("at", "item_at", "words", "item_words")).alias("hits"))
    pairs = shared.filter(F.size(F.array_distinct(F.col("hits.item_at"))) >= LEAST_SHARED)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column("hits")
            flat, offsets = hits.flatten(), hits.offsets.to_numpy() - hits.offsets[0].as_py()
            at, item_at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            words, item_words = flat.field(2).to_pylist(), flat.field(3).to_pylist()
            found = [_compare(at[i:j], item_at[i:j], words[i:j], item_words[i:j], known) for i, j in zip(offsets[:-1], offsets[1:])]
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int32()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "item_id", "run_words", "n_bridged", "same_words", "n_slots", "n_slots_changed", "consistent"])

    out = pairs.mapInArrow(compare, "doc_id long, item_id long, run_words int, n_bridged int, same_words int, n_slots int, n_slots_changed int, consistent boolean")
    return out.filter(F.col("run_words") + F.col("n_bridged") >= LEAST_RUN)
