"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding follows the rule of the library's merge models: every character is a symbol; an *agenda*
of adjacent symbol pairs, ordered by the score of the piece they would form and then from left to
right, is worked off until it is empty; symbols that are no piece fall back to byte pieces. The
agenda is a heap over linked symbols: a merge takes the head, drops it if one of its symbols has
gone, and puts in the two pairs that the new symbol makes with its neighbours. So a run of ``n``
characters takes ``O(n log n)``, whether spaces break it or not. In a word of up to ``SHORT``
characters the agenda is a plain list, which is shorter than a heap's bookkeeping, and the lists of
many words are the rows of a matrix that are worked off side by side: each step takes every row's head.

A piece has the mark ``U+2581`` only at its front (checked when a model is loaded), so no merge
crosses the start of a run of marks: the text falls into *segments* that are encoded alone, and each
distinct one of a block of texts once. A bounded memo keeps segments, as packed ids, between blocks.

The rows have the agenda's ids, and every batch is checked against the sentencepiece library. A text
whose words are parted by single spaces is the sequence of its segments, so each distinct segment is
checked, when the agenda has first encoded it; other texts are checked whole, and so is every text once
a segment has differed. Where agenda and library differ (it would mean a model feature that the
agenda doesn't know), ``agreed`` is false, and with ``strict`` the query fails. A model that normalises
texts in another way than by marks for spaces is refused when it is loaded. Ids are decoded with the
library. The model is read once, where the query is made, and goes to the tasks as a broadcast of its
bytes; a task gives the memo's memory back when it ends.

Edge cases: a null or empty text has the begin and end ids only and decodes to the empty text; a
text of any length is encoded whole; equal scores go from left to right; repeated rows repeat; an
empty table gives an empty result; further columns of the input are ignored by ``digest``.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm import bytework as bw

MARK = "▁"
MEMO_SEGMENTS = 100_000
MEMO_IDS = 1_000_000
CHECKED = 10_000
SHORT = 24
WIDTHS = (6, 8, 10, 13, 17, SHORT)  # words of about one length go side by side
SIDE = 64  # fewer words are encoded one by one
SIDE_ROWS = 16_384
AFAR = np.iinfo(np.int32).max
ABSENT = (1 << 20) - 2  # a character that no piece has
NEVER = 1 << 60
NOTHING = (NEVER, -1)
BATCH_CHARS = 1_500_000
#: A model whose normaliser folds, strips or maps characters shows on one of these.
PROBES = ("a", " a", "a ", "a  b", "  ", "ﬁ Ａ ① é é", "tab\there\nline\r\n", " 　​﻿", "Ⅳ ｶﾞ ㌔ ½", "UPPER lower", MARK + "x" + MARK)
_WORKERS: dict[tuple, "Encoder"] = {}


class EncodingMismatch(ValueError):
    """The agenda and the library disagree on a text."""


class Encoder:
    """A merge-type model: its pairs, the agenda and the memo of segments."""

    def __init__(self, model: bytes, strict: bool = False):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.strict = strict
        n = sp.vocab_size()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any(sp.is_unused(i) for i in range(n)) or not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model isn't a merge-type model with byte fallback and marks in front")
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.char_symbol = {c: i for c, i in symbols.items() if len(c) == 1}
        self.vocab = n
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}  # equal scores leave the order to the position
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (place[score[p]], i)
        table = np.array([(a << 20 | b, r, i) for (a, b), (r, i) in self.pairs.items()], np.int64).reshape(-1, 3)
        self.pair_key, self.pair_place, self.pair_piece = table[np.argsort(table[:, 0])].T.copy()
        self.pair_place, self.pair_piece = self.pair_place.astype(np.int32), self.pair_piece.astype(np.int32)
        self.symbol_of = np.full(0x10000, ABSENT, np.int32)
        for c, i in self.char_symbol.items():
            if ord(c) < 0x10000:
                self.symbol_of[ord(c)] = i
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}  # the memo before it was full
        self.held = 0
        self.fresh: list[str] = []  # segments that the library hasn't seen yet
        self.doubt = False  # a segment has differed: whole texts are compared from then on
        for text in PROBES:
            if self.ids(text) != sp.encode(text):
                raise ValueError("the model isn't a merge-type model without a normaliser")

    def agenda(self, segment: str) -> list[int]:
        """The ids of one segment."""
        return self._short(segment) if len(segment) <= SHORT else self._long(segment)

    def _short(self, segment: str) -> list[int]:
        """The agenda of a word: a list of the pairs' places, whose first least is the head."""
        pairs, own = self.pairs, self.char_symbol
        symbol = [own.get(c, -1) for c in segment]
        if min(symbol) < 0 or max(symbol) >= self.vocab:  # a character that is no piece may be left over
            return self._long(segment)
        made = [pairs.get(x, NOTHING) for x in zip(symbol, symbol[1:])]
        place = [m[0] for m in made]
        while place:
            best = min(place)
            if best == NEVER:
                break
            i = place.index(best)
            piece = symbol[i] = made[i][1]
            del symbol[i + 1], made[i], place[i]
            if i < len(place):
                made[i] = m = pairs.get((piece, symbol[i + 1]), NOTHING)
                place[i] = m[0]
            if i:
                made[i - 1] = m = pairs.get((symbol[i - 1], piece), NOTHING)
                place[i - 1] = m[0]
        return symbol

    def _made(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of pairs of symbols; ``AFAR`` where they make none."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)  # a missing symbol, -1, makes a key that no pair has
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        is_pair = self.pair_key[at] == key
        return np.where(is_pair, self.pair_place[at], AFAR), self.pair_piece[at]

    def _side_by_side(self, texts: list[str]) -> list[bytes]:
        """The packed ids of short words: a row of a matrix is a word's agenda, over linked symbols."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        group, inner = bw.ragged(size)
        n, width = len(texts), int(size.max())
        step = width + 1  # the last column is nothing's: what lies beyond a word's ends
        symbol = np.full((n, step), -1, np.int32)
        symbol[group, inner] = self.symbol_of[points & 0xFFFF]
        odd = np.zeros(n, bool)
        odd[group[points > 0xFFFF]] = True  # not in the table
        place, piece = np.full((n, step), AFAR, np.int32), np.zeros((n, step), np.int32)
        place[:, : width - 1], piece[:, : width - 1] = self._made(symbol[:, : width - 1], symbol[:, 1:width])
        place[odd] = AFAR
        after, before = (np.tile(x.astype(np.int8), (n, 1)) for x in (np.r_[1 : width + 1, width], np.r_[width, 0 : width - 1, width]))
        flat, made, to, of, at = (x.reshape(-1) for x in (symbol, piece, after, before, place))
        rows = np.arange(n)
        while len(rows):
            i = place[rows].argmin(axis=1)
            live = place[rows, i] < AFAR
            rows, i = rows[live], i[live]
            base = rows * step
            here = base + i
            gone = base + to[here]
            new = made[here]
            flat[here], flat[gone], at[gone] = new, -1, AFAR
            right = to[gone]
            to[here] = right
            of[base + right] = i  # of the last column too, which nothing reads
            at[here], made[here] = self._made(new, flat[base + right])
            left = base + of[here]
            at[left], made[left] = self._made(flat[left], new)
        ids = symbol[:, :width]
        there = ids >= 0
        bare = np.flatnonzero((ids >= self.vocab).any(axis=1) & ~odd)  # with characters left over that are no pieces
        packed, end = ids[there].astype("<u4").tobytes(), (4 * np.cumsum(there.sum(axis=1))).tolist()
        out = [packed[a:b] for a, b in zip([0, *end], end)]
        for k, own in zip(bare.tolist(), ids[bare].tolist()):
            out[k] = words(self._pieces(own, texts[k]))
        for k in np.flatnonzero(odd).tolist():
            out[k] = words(self._long(texts[k]))
        return out

    def many(self, segments: list[str]) -> list[bytes]:
        """The packed ids of segments, which have lost their first mark."""
        if len(segments) < SIDE:
            return [words(self.agenda(MARK + s)) for s in segments]
        out: list[bytes] = [b""] * len(segments)
        size = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        least = 0
        for width in WIDTHS:
            own = np.flatnonzero((size > least) & (size <= width)).tolist()
            least = width
            for k in range(0, len(own), SIDE_ROWS):
                part = own[k : k + SIDE_ROWS]
                for i, got in zip(part, self._side_by_side([MARK + segments[i] for i in part])):
                    out[i] = got
        for i in np.flatnonzero(size > least).tolist():
            out[i] = words(self.agenda(MARK + segments[i]))
        return out

    def _long(self, segment: str) -> list[int]:
        """The agenda as a heap over linked symbols."""
        pairs, own = self.pairs, self.char_symbol
        symbol = [own.get(c, -1) for c in segment]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            made = pairs.get((symbol[i], symbol[i + 1]))
            if made:
                heap.append((made[0], i, symbol[i], symbol[i + 1], made[1]))
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, a, b, piece = pop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has gone into another piece
            symbol[i], symbol[j] = piece, -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                made = pairs.get((piece, symbol[k]))
                if made:
                    push(heap, (made[0], i, piece, symbol[k], made[1]))
            h = before[i]
            if h >= 0:
                made = pairs.get((symbol[h], piece))
                if made:
                    push(heap, (made[0], h, symbol[h], piece, made[1]))
        held, i = [-1] * n, 0
        while i < n:
            held[i] = symbol[i] if symbol[i] >= 0 else ABSENT
            i = after[i]
        return self._pieces(held, segment)

    def _pieces(self, symbol: list[int], segment: str) -> list[int]:
        """Ids of the symbols at their first characters; -1: the symbol before goes on."""
        out = []
        for i, x in enumerate(symbol):
            if 0 <= x < self.vocab:
                out.append(x)
            elif x >= 0:  # a character that is no piece: its bytes
                out += [self.byte_ids[b] for b in segment[i].encode("utf-8", "surrogatepass")]
        return out

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text with its added mark, cut in front of every run of marks; each without its first mark."""
        if not text:
            return []
        if Encoder.plain(text):
            return text.split(" ")
        return _SEGMENT.findall(MARK + text.replace(" ", MARK))

    @staticmethod
    def plain(text: str) -> bool:
        """Whether single spaces part the text's words, and nothing else stands for a space."""
        return "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " "

    def learn(self, texts: list[str]) -> None:
        """Have the memo hold all segments of the texts."""
        if self.held > MEMO_IDS or len(self.memo) > MEMO_SEGMENTS:  # what isn't met again goes
            self.elder, self.memo, self.held = self.memo, {}, 0
        memo, elder, met = self.memo, self.elder, set()
        for t in texts:
            met.update(self.segments(t))
        met.difference_update(memo)
        new = [s for s in met if s not in elder]
        again = [s for s in met if s in elder]
        for segments, packed in ((new, self.many(new)), (again, [elder[s] for s in again])):
            memo.update(zip(segments, packed))
            self.held += sum(map(len, packed)) // 4
        self.fresh += new

    def packed(self, text: str) -> bytes:
        """The agenda's ids of a text that is learned, packed, without begin and end."""
        return b"".join(map(self.memo.__getitem__, self.segments(text)))

    def ids(self, text: str) -> list[int]:
        """Ids of a text by the agenda, without begin and end."""
        self.learn([text])
        return unpacked(self.packed(text))

    def release(self) -> None:
        """Give up the memo and its memory: an idle worker's counts against the executor."""
        self.memo, self.elder, self.held = {}, {}, 0
        self.fresh.clear()
        bw.give_back()

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """The agenda's ids of every text, without begin and end, and whether the library has the same."""
        return [(unpacked(ids), same) for ids, same in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """What ``encode`` gives, with packed ids."""
        self.fresh.clear()
        self.learn(texts)
        mine = [self.packed(t) for t in texts]
        asked = [s for s in self.fresh if MARK not in s]  # others are parts of texts that are compared whole
        self.fresh.clear()
        for i in range(0, len(asked), CHECKED):
            part = asked[i : i + CHECKED]
            mine_of, theirs = [self.memo[s] for s in part], self.lib.encode(part, num_threads=1)
            self.doubt |= [len(x) // 4 for x in mine_of] != list(map(len, theirs)) or b"".join(mine_of) != words(list(chain.from_iterable(theirs)))
        whole = [i for i, t in enumerate(texts) if self.doubt or not self.plain(t)]
        agreed = [True] * len(texts)
        for i, theirs in zip(whole, self.lib.encode([texts[i] for i in whole], num_threads=1) if whole else ()):
            agreed[i] = mine[i] == words(theirs)
            if self.strict and not agreed[i]:
                raise EncodingMismatch(f"the agenda and the library differ on a text of {len(texts[i])} characters")
        return list(zip(mine, agreed))


_SEGMENT = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def worker_encoder(name: str, model: Callable[[], bytes], strict: bool = False) -> Encoder:
    """One encoder for each Python worker and model, by the digest of its bytes."""
    if (name, strict) not in _WORKERS:
        _WORKERS[name, strict] = Encoder(model(), strict)
    return _WORKERS[name, strict]


def words(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if array("I").itemsize == 4 and sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def blocks(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Texts in lists of about ``BATCH_CHARS`` characters; a longer text stands alone."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= BATCH_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def digest(docs: DataFrame, model: str | bytes, begin: int = 1, end: int = 2, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, agreed`` and the columns in ``keep``.

    ``model`` is the path of a model file that the driver can read, or its bytes.
    """
    data = model if isinstance(model, bytes) else read_model(model)
    name, shared = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)
    first, last = words([begin]), words([end])
    extra = list(keep)
    fields = ["doc_id", *extra]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in fields] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "agreed boolean"])

    def run(batches):
        enc = worker_encoder(name, lambda: shared.value, strict)
        gc.disable()  # the memo's many lists make no cycles, and would be looked through again and again
        try:
            yield from encoded(enc, batches)
        finally:
            gc.enable()
            enc.release()

    def encoded(enc, batches):
        for batch in batches:
            n, hashes, decoded, agreed = [], [], [], []
            for texts in blocks(x.as_py() for x in batch.column(batch.num_columns - 1)):
                for ids, same in enc.encode_packed(texts):
                    whole = first + ids + last
                    n.append(len(whole) // 4)
                    hashes.append(hashlib.sha256(whole).hexdigest())
                    decoded.append(hashlib.sha256(enc.lib.decode(unpacked(whole)).encode("utf-8")).hexdigest())
                    agreed.append(same)
            cols = [batch.column(i) for i in range(len(fields))]
            yield pa.record_batch([*cols, pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(agreed)], names=[*fields, "n_tokens", "ids_sha256", "decoded_sha256", "agreed"])

    return docs.select(*fields, "text").mapInArrow(run, schema)
