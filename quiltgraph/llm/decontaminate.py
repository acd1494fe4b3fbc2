"""Benchmark decontamination by templates.

Words become a template: numbers, units and names (capitalised words) turn into typed placeholders, so a
question with other numbers or names keeps its template. Only names depend on case; a second template
takes them as words, so a text in other case keeps that one (a window whose case and name both differ is
not found: in other case a new name looks like a word). Windows of five template words of the benchmark,
of both templates, are hash-joined with those of the documents; a window of placeholders alone says nothing and
is joined by its words. Of the places that a window of an item has in the document, that one counts whose shift
most of the item's windows share. Then the slots are checked: each value of the item must stand for one value of
the document throughout, and no two values of one type for the same; windows that break this do not count, unless
they have the item's own words. An item whose counted windows are at least 0.8 of its own is contained in the
document. Where the whole document has fewer, stretches of one and a half times the item's length are tried, so
that other copies elsewhere do not hide one. Time grows with the matches of the windows, not with their pairs.

The benchmark's windows are sent to the executors in blocks of bounded size; each block is one pass over
the documents, which are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SIMILARITY = 5, 0.8
#: Windows of the benchmark sent to the executors at a time (about 100 bytes each, in two templates).
BLOCK_WINDOWS = 500_000
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ounce ounces ton tons"
    " ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks"
    " month months year years usd eur gbp dollar dollars cent cents euro euros percent degree degrees mph kmh kph watt watts"
    " volt volts amp amps joule joules newton newtons hz khz mhz byte bytes kb mb gb tb".split()
)
NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*(?:st|nd|rd|th)?$")
NUMBER_UNIT = re.compile(r"([+-]?[0-9]+(?:[.,][0-9]+)*)([a-z%]+)$")
EDGES = re.compile(r"^\W+|\W+$")


def template(word: str) -> tuple[tuple[str, str], ...]:
    """Template words of a word, each with its slot value ("" outside slots); none for mere punctuation."""
    core, low = word, word.casefold()
    if not word.isalpha():  # letters alone have no edges and are no number
        lead = "$" if word[:1] in "$€£" else ""
        core = EDGES.sub("", word)
        if not core:
            return ()
        low = core.casefold()
        if NUMBER.match(low):
            return (("<num>", low), ("<unit>", lead)) if lead else (("<num>", low),)
        if (m := NUMBER_UNIT.match(low)) and m[2] in UNITS:
            return ("<num>", m[1]), ("<unit>", m[2])
    if low in UNITS:
        return (("<unit>", low),)
    if len(core) > 1 and core[0].isupper() and core[1:] == core[1:].lower():
        return (("<name>", low),)
    return ((low, ""),)


def said(token: tuple[str, str]) -> str:
    """The word of a template word, in lower case."""
    return token[1] or token[0]


def _digest(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Words:
    """Hashes of template words, and of windows over them.

    Words are numbered as they come; beyond ``common.MEMO_ENTRIES`` the numbers start anew.
    """

    def __init__(self) -> None:
        self.memo = common.Memo(self._number)
        # of each word: its first template word and how many it has; of each template word: hashes in both templates, and of the word
        self.words, self.tokens = np.empty((0, 2), np.int64), np.empty((0, 3), np.uint64)
        self.n_words = self.n_tokens = 0  # in use; those not yet in the arrays:
        self.new_words: list[int] = []
        self.new_tokens: list[int] = []

    def _number(self, word: str) -> int:
        made = template(word)
        self.new_words += (self.n_tokens + len(self.new_tokens) // 3, len(made))
        for kind, value in made:
            digest, own = _digest(kind), _digest(value or kind)
            self.new_tokens += (digest, own if kind == "<name>" else digest, own)
        return len(self.memo)

    @staticmethod
    def _put(table: np.ndarray, n: int, new: list[int]) -> np.ndarray:
        """``table`` with the rows of ``new`` from row ``n`` on, larger if it must be."""
        rows = np.array(new, table.dtype).reshape(-1, table.shape[1])
        if n + len(rows) > len(table):
            table = np.concatenate([table[:n], np.empty((n + 2 * len(rows), table.shape[1]), table.dtype)])
        table[n : n + len(rows)] = rows
        return table

    def hashes(self, text: str | None) -> np.ndarray:
        """``(3, template words)``: hashes with names as placeholders, with names as words, and of the words."""
        words = (text or "").split()
        if len(self.memo) + len(words) > self.memo.limit:  # a text's numbers must not start anew within it
            self.memo.clear()
            self.memo.limit = max(self.memo.limit, len(words))
            self.n_words = self.n_tokens = 0
        numbers = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if self.new_words:
            self.words, self.tokens = self._put(self.words, self.n_words, self.new_words), self._put(self.tokens, self.n_tokens, self.new_tokens)
            self.n_words, self.n_tokens = self.n_words + len(self.new_words) // 2, self.n_tokens + len(self.new_tokens) // 3
            self.new_words, self.new_tokens = [], []
        first, many = self.words[numbers].T
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.ascontiguousarray(self.tokens[at].T)

    @staticmethod
    def mixed(hashes: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(hashes) - size + 1, np.uint64)
        for i in range(size):
            total = (total ^ hashes[i : len(hashes) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        return total

    @classmethod
    def windows(cls, hashes: np.ndarray, size: int) -> list[np.ndarray]:
        """Of both templates of :meth:`hashes`; windows without a word of their own are those of the words."""
        if hashes.shape[1] < size:
            return [np.empty(0, np.uint64)] * 2
        found, own = [], None
        for h in hashes[:2]:
            total, upto = cls.mixed(h, size), np.concatenate([[0], np.cumsum(h == hashes[2])])
            bare = np.flatnonzero(upto[size:] == upto[:-size])
            if len(bare):
                own = cls.mixed(hashes[2], size) if own is None else own
                total[bare] = own[bare]
            found.append(total)
        return found


@dataclass
class Known:
    """Distinct windows of each item, of one size and template, sorted by hash: item, and where ``at`` lists its places in it."""

    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    at: np.ndarray
    table: np.ndarray  # of the hashes' high bits

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Known:
        hashes, item, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, item, hashes))
        hashes, item, at = hashes[order], item[order], at[order]
        fresh = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])]))
        bits = min(max(16, len(hashes).bit_length() + 4), 26)
        table = np.zeros(1 << bits, bool)
        table[hashes >> np.uint64(64 - bits)] = True
        return cls(hashes[fresh], item[fresh], np.append(fresh, len(at)), at, table)

    def meet(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the index and place in ``windows`` of all equal pairs."""
        may = np.flatnonzero(self.table[windows >> np.uint64(65 - len(self.table).bit_length())])
        first, last = (np.searchsorted(self.hashes, windows[may], side) for side in ("left", "right"))
        many = last - first
        return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum()), np.repeat(may, many)


@dataclass
class Index:
    """Windows of a block of items: by size, those of both templates."""

    items: list[tuple[int | None, str]]
    sizes: dict[int, tuple[Known, Known]]
    totals: np.ndarray  # windows of each item

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], window: int = WINDOW) -> Index:
        words, found, totals = Words(), {}, []
        for i, (_, text) in enumerate(items):
            hashes = words.hashes(text)
            size = min(window, hashes.shape[1])  # an item of fewer words is one window of all of them
            n = hashes.shape[1] - size + 1 if size else 0
            totals.append(n)
            if size:
                found.setdefault(size, []).append([(h, np.full(n, i), np.arange(n)) for h in Words.windows(hashes, size)])
        return cls(items, {size: tuple(Known.of(x) for x in zip(*parts)) for size, parts in found.items()}, np.array(totals))


def slots(text: str) -> list[tuple[str, str]]:
    return [t for w in (text or "").split() for t in template(w)]


def consistent(pairs: list[tuple[int, int]], item: list[tuple[str, str]], doc: list[tuple[str, str]], size: int) -> int:
    """How many of the item's windows, given as (its position, the document's), keep every slot's commonest value or all words."""
    votes: dict[tuple[str, str], Counter] = {}
    for a, b in dict.fromkeys((i + k, j + k) for i, j in pairs for k in range(size)):
        if item[a][1]:
            votes.setdefault(item[a], Counter())[said(doc[b])] += 1
    chosen = {slot: min(found.items(), key=lambda x: (-x[1], x[0] != slot[1], x[0]))[0] for slot, found in votes.items()}
    # two values of one type must not stand for the same: the one with more votes keeps it
    owner: dict[tuple[str, str], tuple[str, str]] = {}
    for slot in sorted(chosen, key=lambda s: (-votes[s][chosen[s]], s)):
        owner.setdefault((slot[0], chosen[slot]), slot)
    good = set()
    for i, j in pairs:
        same = all(said(item[i + k]) == said(doc[j + k]) for k in range(size))
        if same or all(not item[i + k][1] or chosen[item[i + k]] == said(doc[j + k]) and owner[item[i + k][0], said(doc[j + k])] == item[i + k] for k in range(size)):
            good.add(i)
    return len(good)


Hits = list[tuple[np.ndarray, np.ndarray]]


def aligned(hits: Hits, total: int, low: int, high: int) -> list[tuple[int, int]]:
    """For each of an item's windows with a place in the document from ``low`` to ``high``, the one of the commonest shift.

    ``hits`` are pairs of a window's places in the item and in the document, sorted. Pieces of an item lie
    at shifts of their own; a window that stands by chance at other shifts too is taken from the piece with
    most windows, the first of them if several have as many.
    """
    shifts = np.zeros(high - low + total, np.int32)  # a shift is counted once for each window
    near = [(at, x) for at, doc_at in hits if len(x := doc_at[slice(*np.searchsorted(doc_at, (low, high)))] - low + total)]
    for at, x in near:
        for i in at.tolist():
            shifts[x - i] += 1
    best: dict[int, tuple[int, int]] = {}
    for at, x in near:
        for i in at.tolist():
            many = shifts[x - i]
            k = int(many.argmax())
            best[i] = max(best.get(i, (0, 0)), (int(many[k]), -int(x[k])))  # by both templates
    return [(i, low - total - at) for i, (_, at) in sorted(best.items())]


def stretches(hits: Hits, length: int, need: float, apart: int) -> list[int]:
    """Where stretches of the document begin that may hold enough of an item's windows: fullest first, none near another."""
    at = np.concatenate([x for _, x in hits])
    which = np.repeat(np.arange(len(hits)), [len(x) for _, x in hits])
    order = np.argsort(at, kind="stable")
    at, which = at[order].tolist(), which[order].tolist()
    weights, inside, full, last, found = [len(x) for x, _ in hits], [0] * len(hits), 0, 0, []
    for first, begin in enumerate(at):
        while last < len(at) and at[last] < begin + length:
            full += weights[which[last]] if not inside[which[last]] else 0
            inside[which[last]] += 1
            last += 1
        if full >= need:
            found.append((-full, begin))
        inside[which[first]] -= 1
        full -= weights[which[first]] if not inside[which[first]] else 0
    taken: list[int] = []
    for _, begin in sorted(found):
        k = bisect_left(taken, begin)
        if all(abs(begin - x) > apart for x in taken[max(k - 1, 0) : k + 1]):
            taken.insert(k, begin)
    return taken


def contained(text: str | None, words: Words, index: Index, similarity: float = SIMILARITY) -> list[tuple[int, float]]:
    """Numbers of the items in a text, with the share of their windows found."""
    hashes, found, doc = words.hashes(text), [], None
    for size, both in index.sizes.items():
        if hashes.shape[1] < size:
            continue
        met, covered = [], np.zeros(len(index.totals), np.int64)
        for known, windows in zip(both, Words.windows(hashes, size)):
            rows, doc_at = known.meet(windows)
            if len(rows):
                order = np.lexsort((doc_at, rows, known.item[rows]))
                rows, doc_at = rows[order], doc_at[order]
                once = np.unique(rows)
                np.add.at(covered, known.item[once], known.start[once + 1] - known.start[once])
                met.append((known, rows, doc_at, known.item[rows]))
        # an item has at most as many windows in the document as both templates together
        for i in np.flatnonzero((covered > 0) & (covered >= similarity * index.totals - 1e-9)).tolist():
            total = int(index.totals[i])
            need, hits, has = similarity * total - 1e-9, [], np.zeros(total, bool)
            for known, rows, doc_at, item in met:
                a, b = np.searchsorted(item, (i, i + 1))
                cut = np.flatnonzero(rows[a + 1 : b] != rows[a : b - 1]) + a + 1
                for begin, end in zip([a, *cut], [*cut, b]):
                    if begin < end:
                        row = rows[begin]
                        hits.append((known.at[known.start[row] : known.start[row + 1]], doc_at[begin:end]))
                        has[hits[-1][0]] = True
            if has.sum() < need:
                continue
            doc = slots(text) if doc is None else doc
            own, whole = slots(index.items[i][1]), hashes.shape[1] - size + 1
            best = consistent(aligned(hits, total, 0, whole), own, doc, size)
            length = total + total // 2 + 1
            if best < need and whole > length:
                for begin in stretches(hits, length, need, total // 2):
                    best = max(best, consistent(aligned(hits, total, begin, begin + length), own, doc, size))
                    if best == total:
                        break
            if best >= need:
                found.append((i, best / total))
    return sorted(found)


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``most`` words, in order of their id."""
    block, n = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator()
    for row in rows:
        size = row.t.count(" ") + 1
        if block and n + size > most:
            yield block
            block, n = [], 0
        block.append((row.i, row.t))
        n += size
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``keep``, ``item_id`` and ``similarity`` of every pair of a row and a benchmark item that it contains.

    Null, empty or wordless texts contain nothing and are contained in nothing; an item of fewer than
    five words is one window of them all. Rows and items that repeat give a row for each pair; null ids
    are kept. Without documents or items the result is empty. Texts are read whole; other columns are
    not read.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    names, kind = [*keep, "item_id", "similarity"], dict(benchmark.dtypes)[item_id]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", item_id {kind}, similarity double"
    found = None
    for block in blocks(benchmark, item_id, item_text, block_windows):
        sent = spark.sparkContext.broadcast(Index.of(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, words = sent.value, Words()
            for batch in batches:
                for part in common.slices(batch):
                    got = [(n, i, s) for n, t in enumerate(part.column(text).to_pylist()) for i, s in contained(t, words, index, similarity)]
                    if got:
                        rows = pa.array([g[0] for g in got])
                        yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in keep), pa.array([index.items[g[1]][0] for g in got], pa.int64() if kind == "bigint" else None), pa.array([g[2] for g in got], pa.float64())], names=names)

        part = docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; columns stay as they are."""
    row, bad, bad_id = common.unused(docs.columns, "row", "bad", "bad_id")
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = leaks(marked.select(row, "doc_id", "text"), benchmark, keep=(row, "doc_id")).select(F.col(row).alias(bad), F.col("doc_id").alias(bad_id))
    leaking = common.written(found.distinct(), "leaks")
    return marked.join(leaking, (F.col(row) == F.col(bad)) & F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti").select(docs.columns)
