"""SentencePiece encoding and decoding by a streaming Viterbi over a window of the longest piece.

The lattice has a node at every character boundary and an arc for every piece. A unigram model scores
a path by the sum of its pieces; a BPE model allows a path only if each two neighbouring pieces are
what merging their joined string gives, which holds for exactly one path to each boundary, the
merges' own result (merges on both sides of a boundary do not affect one another until one crosses
it, and the first to cross would also cross in the two pieces alone). Backpointers are kept for a
window of the longest piece; once the paths from all boundaries in it meet in one boundary, what
lies before is final and its ids are committed. A boundary that no piece can span, such as before a
word's first mark, is one where all paths meet, so words commit one by one and repeat from a memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common

MARK = "▁"  # stands for a space in pieces
#: Longer words are encoded in the stream without the memo.
MEMO_WORD = 48
#: First characters of a word whose paths are kept for other words.
HEAD = 6
UNIGRAM, BPE = 1, 2
#: The score of a merge that there is not.
NEVER = float("-inf")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class Codec:
    """Encodes and decodes with a SentencePiece model file (BPE or unigram), ids as the library gives them."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        library, n = self.library, self.library.get_piece_size()
        self.kind = next((v for k, part in fields(library.serialized_model_proto()) if k == 2 for f, v in fields(part) if f == 3), UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only BPE and unigram models are supported")
        self.names = [library.id_to_piece(i) for i in range(n)]
        self.scores = [library.get_score(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.names) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.names) if library.is_byte(i)}
        self.longest = max(map(len, self.ids))
        #: The ids of pieces, and -1 for what is only the end of a piece.
        self.tails = dict.fromkeys((p[i:] for p in self.ids for i in range(len(p))), -1) | self.ids
        self.unknown = library.unk_id()
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10
        #: No piece holds a mark after another character: then words are apart.
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        probe = " a  béﬁ "
        self.plain = library.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.fits = common.Memo(self._fits)
        self.merges = common.Memo(self._merges)  # at most one for each piece
        self.lengths = [*map(len, self.names), 1]  # the last for an unknown character
        self.heads = common.Memo(lambda head: self._paths(head, [-1]))
        self.word_ids = common.Memo(lambda word: (np.array(self.word(word), np.int32) if self.kind == BPE else np.fromiter(self.stream(word), np.int32)).tobytes())
        self.texts = [self._text(i) for i in range(n)]

    def normalize(self, text: str) -> str:
        """The text as the lattice sees it: with a mark for each space and before the first character."""
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def _fits(self, pair: int) -> bool:
        """Whether a piece can follow another (-1: none, or an unknown character); the pair is coded as a number."""
        before, piece = divmod(pair, len(self.names))
        after = self.merges[self.names[piece]]
        if before < 1 or after is None:
            return after is not None
        if (first := self.merges[self.names[before - 1]]) is None:
            return False
        # merges on each side go on alone until one across the boundary has a better score, or the same further left
        (left, _, ends), (right, starts, _), ids, scores, i, j = first, after, self.ids, self.scores, 0, 0
        while True:
            across = ids.get(ends[i] + starts[j])
            if across is not None and scores[across] > left[i] and scores[across] >= right[j]:
                return False
            if left[i] < right[j]:
                j += 1
            elif left[i] == NEVER:
                return True
            else:
                i += 1

    def _merges(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make a piece, in turn and :data:`NEVER` at the end, with the first and last part before each; None if merging does not."""
        steps: list[tuple[float, str, str]] = []
        return tuple(map(list, zip(*steps))) if self.merged(piece, steps) == [piece] else None

    def merged(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Pieces of a short text by merging, each time, the neighbours with the best joined piece, leftmost first; ``steps`` as :meth:`_merges` has them."""
        parts = list(text)
        while True:
            best = max(((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids), default=None)
            if steps is not None:
                steps.append((NEVER if best is None else best[0], parts[0], parts[-1]))
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def word(self, text: str) -> list[int]:
        """Ids of a short normalised text with a BPE model: as :meth:`stream`, in a window that holds all of it. Words share the paths of their first characters."""
        last = self._paths(text, list(self.heads[text[:HEAD]]))
        return self._numbers(text, last, [self.lengths[i] for i in last], len(text))

    def _paths(self, text: str, last: list[int]) -> list[int]:
        """``last``, the piece on the one path to each of the first boundaries (-1: an unknown character), continued to the end of a text."""
        tails, fits, n = self.tails, self.fits, len(self.names)
        for end in range(len(last), len(text) + 1):
            piece = -1
            for at in range(end - 1, -1, -1):
                i = tails.get(text[at:end])
                if i is None:
                    break
                if i >= 0 and fits[(last[at] + 1) * n + i]:
                    piece = i
                    break
            last.append(piece)
        return last

    def stream(self, text: Iterable[str]) -> Iterator[int]:
        """Ids of a normalised text, given as characters, committed as soon as all paths agree."""
        ids, scores, fits, tails, n, bpe = self.ids, self.scores, self.fits, self.tails, len(self.names), self.kind == BPE
        window = ""  # the characters since the last committed boundary
        last = [-1]  # the piece on the best path to each boundary of the window (-1: an unknown character); at 0 the last committed one
        sizes = [0]  # and its length
        total = [0.0]
        full = 2 * self.longest
        for c in text:
            window += c
            end = len(window)
            best, piece, width = None, -1, 1
            for at in range(end - 1, -1, -1):
                i = tails.get(window[at:])
                if i is None:
                    break
                if i < 0:
                    continue
                if bpe:
                    if fits[(last[at] + 1) * n + i]:  # the one path
                        best, piece, width = 0.0, i, end - at
                        break
                elif best is None or total[at] + scores[i] > best:
                    best, piece, width = total[at] + scores[i], i, end - at
            if best is None or not bpe and c not in ids and total[-1] + self.unknown_score > best:
                best, piece, width = total[-1] + self.unknown_score, -1, 1
            total.append(best)
            last.append(piece)
            sizes.append(width)
            if end >= full and (cut := self._agreed(sizes, end)):
                yield from self._numbers(window, last, sizes, cut)
                window, last, sizes, total = window[cut:], last[cut:], sizes[cut:], total[cut:]
        yield from self._numbers(window, last, sizes, len(window))

    def _agreed(self, sizes: list[int], end: int) -> int:
        """The latest boundary on the paths of all boundaries that a later piece can start at."""
        heads = set(range(max(0, end - self.longest + 1), end + 1))
        while len(heads) > 1:
            at = max(heads)
            heads.remove(at)
            heads.add(at - sizes[at])
        return heads.pop()

    def _numbers(self, window: str, last: list[int], sizes: list[int], end: int) -> list[int]:
        """Ids of the path to boundary ``end``."""
        found = []
        while end > 0:
            if last[end] >= 0:
                found.append(last[end])
            elif self.bytes:
                found += [self.bytes[b] for b in reversed(window[end - 1].encode("utf-8", "surrogatepass"))]
            else:
                found.append(self.unknown)
            end -= sizes[end]
        return found[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one."""
        text = self.normalize(text or "")
        if not self.words_apart:
            return np.fromiter(self.stream(text), np.int32)
        memo, parts = self.word_ids, []
        for word in WORDS.findall(text):
            parts.append(memo[word] if len(word) <= MEMO_WORD else np.fromiter(self.stream(word), np.int32).tobytes())
        return np.frombuffer(b"".join(parts), np.int32)

    def _text(self, i: int) -> str | None:
        """What an id decodes to; None for a byte."""
        if self.library.is_byte(i):
            return None
        if self.library.is_control(i):
            return ""
        return " ⁇ " if self.library.is_unknown(i) else self.names[i].replace(MARK, " ")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: pieces joined without the first mark, runs of byte pieces read as UTF-8."""
        texts = self.texts
        parts = [texts[i] for i in ids.tolist()]
        if None in parts:
            names, at, joined = self.names, 0, []
            while at < len(parts):
                if parts[at] is not None:
                    joined.append(parts[at])
                    at += 1
                    continue
                run = bytearray()
                while at < len(parts) and parts[at] is None:
                    run.append(int(names[ids[at]][1:-1], 16))
                    at += 1
                joined.append(run.decode("utf-8", "replace"))
            parts = joined
        text = "".join(parts)
        return text[1:] if text[:1] == " " and len(ids) and self.names[ids[0]].startswith(MARK) else text


#: A run of marks with what follows it, or what stands before the first mark.
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` (array of int), ``n_tokens`` and ``decoded`` (text read back from the ids) of each row.

    ``model`` is the path of the model file on every executor. Null and empty texts have no ids and an
    empty ``decoded``. Texts of any length are encoded whole in bounded memory besides their own ids.
    Repeated rows and rows with null ids come out like others; an empty table gives an empty one; columns
    outside ``keep`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)

        def rows(texts: list) -> dict[str, pa.Array]:
            ids = [c.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())), "n_tokens": pa.array(np.diff(ends), pa.int64()), "decoded": pa.array([c.decode(i) for i in ids], pa.string())}

        return common.per_document(batches, text, rows, keep)

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ids array<int>, n_tokens bigint, decoded string")
