"""Language ID with a linear-chain conditional random field over the words of each line.

A word is a run of letters and their marks, of any script, lower-cased for A-Z and the Latin-1 letters.
Its features: the word itself (a lexicon learned from the sample), prefixes of one to three bytes,
suffixes of one to four bytes, and all byte trigrams of the word with its borders. Features are
hashed into tables of fixed size. A chain is a line, or ``CHAIN`` words of a longer one; learned
transitions tie neighbouring words, and forward-backward gives each word's posterior over the
languages, so code-switched text is labelled word by word. A document's language is the one with
the largest share of its words' posteriors; the share is the score. Posteriors are computed for all
words of all documents, whole texts, many chains at once in numpy; ``word_labels`` returns them.

Training maximises the conditional likelihood by AdaGrad on a bounded sample: of the ``SAMPLE_LANGS``
languages that most documents have, up to ``SAMPLE_DOCS`` documents each and ``SAMPLE_TOTAL`` in all,
those with the smallest hashes of their ids (documents are counted first, and only hashes below a
threshold that leaves about twice as many are ranked), and up to ``SAMPLE_LINES`` lines
spread over each (fewer, evenly, if words times languages exceed ``SAMPLE_CELLS``, which bounds the
memory of training); of a document of more than ``SAMPLE_CHARS`` characters, lines with letters, each
from its first letter on and no longer than its share of ``SAMPLE_CHARS``. Language, source and id
are never inputs of a prediction. The model has a fixed size for a number of languages, so it is
broadcast.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is everything if no
labelled row can be learned from; null ids are kept (they are in the learning part) and null
languages are never learned from; ties between languages go to the first in alphabetical order; repeated rows are
predicted one by one; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import bytework as bw

SAMPLE_DOCS = 300
SAMPLE_TOTAL = 6000
SAMPLE_LANGS = 200
SAMPLE_CHARS = 20_000
SAMPLE_LINES = 12
SAMPLE_CELLS = 40_000_000
WORD = re.compile(r"[^\W\d_]+")
CHAIN = 256
EPOCHS = 12
RATE = 0.5
DECAY = 1e-6
WORD_BITS = 17
GRAM_BITS = 15
FOLDS = 5
CHUNK_BYTES = 500_000  # a worker holds some hundred bytes for each while it labels

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes: A-Z, and the two-byte letters U+00C0 to U+00DE."""
    out = LOWER[data]
    if len(out) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


class _Letters:
    """Which code points beyond ASCII are letters or marks."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.zeros(0x110000, bool)
            for c in range(0x80, 0x110000):
                cls.table[c] = unicodedata.category(chr(c))[0] in "LM"
        return cls.table[np.minimum(points, 0x10FFFF)]


def letters(data: np.ndarray) -> np.ndarray:
    """The bytes of ASCII letters and of other letters and marks, in valid UTF-8."""
    inside = LETTER[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        byte = lambda k: np.where(lead + k < len(data), data[np.minimum(lead + k, len(data) - 1)], 0).astype(np.int64) & 0x3F
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        two, three = (first & 0x1F) << 6 | byte(1), (first & 0x0F) << 12 | byte(1) << 6 | byte(2)
        four = (first & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
        other = ~_Letters.of(np.where(size == 2, two, np.where(size == 3, three, four)))
        for k in range(4):
            at = lead[other & (size > k)] + k
            inside[at[at < len(data)]] = False
    return inside


def words_and_chains(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of every chain."""
    inside = letters(data)
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, np.int64)
    line = np.cumsum(data == 0x0A)[begin]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[first, len(begin)])
    if size.max() > CHAIN:
        group, place = bw.ragged(-(-size // CHAIN))
        first = first[group] + place * CHAIN
    return begin, end, first


def features(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word and affix features (words x 8), hashed trigrams, and the first trigram of each word."""
    size = end - begin
    mask = np.uint64((1 << WORD_BITS) - 1)
    padded = np.r_[low, np.zeros(4, np.uint8)].astype(np.uint64)
    out = np.empty((len(begin), 8), np.int32)
    out[:, 0] = (bw.Slices(low)(begin, end) & mask).astype(np.int32)
    code = np.zeros(len(begin), np.uint64)
    for k in range(3):
        code = code * np.uint64(257) + np.where(size > k, padded[begin + k] + np.uint64(1), np.uint64(0))
        out[:, 1 + k] = (bw.mix(code + np.uint64((k + 1) << 40)) & mask).astype(np.int32)
    code = np.zeros(len(begin), np.uint64)
    for k in range(4):
        code = code * np.uint64(257) + np.where(size > k, padded[np.maximum(end - 1 - k, 0)] + np.uint64(1), np.uint64(0))
        out[:, 4 + k] = (bw.mix(code + np.uint64((k + 11) << 40)) & mask).astype(np.int32)
    # trigrams centred on each byte of a word; what lies outside the word counts as 0
    centre, place = bw.ragged(size)
    at = begin[centre] + place
    left = np.where(place > 0, low[np.maximum(at - 1, 0)], 0).astype(np.uint32)
    right = np.where(place < size[centre] - 1, padded[at + 1], 0).astype(np.uint32)
    gram = (left * np.uint32(31_415_821) + low[at].astype(np.uint32) * np.uint32(2_654_435_761) + right * np.uint32(40_503_003)) >> np.uint32(32 - GRAM_BITS)
    return out, gram.astype(np.int32), np.cumsum(size) - size


@dataclass
class Model:
    """Weights of the features and transitions, and the languages in order."""

    langs: list[str]
    words: np.ndarray
    grams: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def scores(self, feats) -> np.ndarray:
        word, gram, first = feats
        out = np.add.reduceat(self.grams[gram], first, axis=0)
        for k in range(word.shape[1]):
            out += self.words[word[:, k]]
        return out


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray, pairs: bool = False):
    """Posteriors of every word; with ``pairs`` also the expected transitions, starts and the log-likelihood's norm.

    Chains run side by side, longest first, so that step ``t`` works on a prefix of them.
    """
    n, k = scores.shape
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - top)
    step = np.exp(moves - moves.max())
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # chains longer than t
    alpha = np.empty((n, k), scores.dtype)
    a = emit[first] * np.exp(starts - starts.max())
    a /= a.sum(axis=1, keepdims=True)
    alpha[first] = a
    for t in range(1, int(size[0])):
        at = first[: live[t]] + t
        a = (a[: live[t]] @ step) * emit[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    post = alpha.copy()
    expected = np.zeros((k, k))
    b = np.zeros((0, k), scores.dtype)
    for t in range(int(size[0]) - 2, -1, -1):
        m = live[t + 1]
        at = first[:m] + t
        if len(b) < m:
            b = np.concatenate([b, np.ones((m - len(b), k), scores.dtype)])
        c = emit[at + 1] * b[:m]
        c /= c.sum(axis=1, keepdims=True)
        b = c @ step.T
        p = alpha[at] * b
        norm = p.sum(axis=1, keepdims=True)
        post[at] = p / norm
        if pairs:
            expected += ((alpha[at] / norm).T @ c) * step
    return post, expected, post[first]


def train(texts: list[str], langs: list[str]) -> Model:
    """Fit on documents of one language each; see the module's text for the bounds."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    lines, labels = [], []
    for text, lang in zip(texts, langs):
        own = [x for x in text.split("\n") if x.strip()]
        for i in sorted({len(own) * j // SAMPLE_LINES for j in range(SAMPLE_LINES)} if own else ()):
            lines.append(own[i])
            labels.append(number[lang])
    step = -(-sum(len(WORD.findall(x)) for x in lines) * len(names) // SAMPLE_CELLS)
    if step > 1:  # every step-th line of each language
        nth = [count() for _ in names]
        kept = [i for i, x in enumerate(labels) if next(nth[x]) % step == 0]
        lines, labels = [lines[i] for i in kept], [labels[i] for i in kept]
    data = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    begin, end, first = words_and_chains(data)
    feats = features(folded(data), begin, end)
    line_of = np.cumsum(data == 0x0A)[begin]
    truth = np.array(labels)[line_of]
    k = len(names)
    model = Model(names, np.zeros((1 << WORD_BITS, k), np.float32), np.zeros((1 << GRAM_BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    sums = [np.full(w.shape, 1e-8) for w in (model.words, model.grams, model.moves, model.starts)]
    inner = np.ones(len(begin), bool)
    inner[first] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    gram_word = np.repeat(np.arange(len(begin)), end - begin)
    for _ in range(EPOCHS):
        post, expected, start = forward_backward(model.scores(feats).astype(np.float64), first, model.moves, model.starts, pairs=True)
        post *= -1 / len(begin)  # in place: the labels less the posterior
        post[np.arange(len(begin)), truth] += 1 / len(begin)
        miss = post
        words, grams = np.zeros(model.words.shape), np.zeros(model.grams.shape)
        for j in range(k):
            for f in range(feats[0].shape[1]):
                words[:, j] += np.bincount(feats[0][:, f], miss[:, j], len(words))
            grams[:, j] = np.bincount(feats[1], miss[gram_word, j], len(grams))
        for w, g, s in zip((model.words, model.grams, model.moves, model.starts), (words, grams, (seen - expected) / len(begin), np.bincount(truth[first], minlength=k) / len(first) - start.mean(0)), sums):
            g = g - DECAY * w
            s += g * g
            w += (RATE * g / np.sqrt(s)).astype(w.dtype)
    model.moves = model.moves.astype(np.float32)
    model.starts = model.starts.astype(np.float32)
    return model


def sample_text(text: Column) -> Column:
    """What training may read of a text: all of a short one, slices of ``SAMPLE_LINES`` lines of a longer one."""
    own = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\p{L}"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_LINES - 1)), lambda j: F.floor(F.size(own) * j / SAMPLE_LINES).cast("int")))
    share = F.floor(F.lit(SAMPLE_CHARS) / F.size(places)).cast("int")
    lines = F.transform(places, lambda i: F.substring(F.regexp_replace(F.get(own, i), r"^\P{L}++", ""), F.lit(1), share))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(lines, "\n"))


def fit(docs: DataFrame) -> Model | None:
    """Train on the bounded sample of ``docs``; None if there is nothing to learn from."""
    able = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(SAMPLE_LANGS).collect()
    if not counts:
        return None
    want = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts)))
    # about twice as many pass as are wanted, so nearly always enough do
    bound = lambda n: (1 << 63) - 1 if n <= 4 * want else (2 * want << 64) // n - (1 << 63)
    limits = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], bound(r["n"])) for r in counts], "lang string, bound long"))
    near = able.withColumn("h", F.xxhash64("doc_id", F.lit(3))).join(limits, "lang").where(F.col("h") <= F.col("bound"))
    drawn = near.select("lang", "h", sample_text(F.col("text")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= want).orderBy("h", "lang", "text").select("text", "lang").collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def word_labels(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, labels``: each word's bytes (in the text's UTF-8, end exclusive), language and posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            out: list = [[] for _ in range(batch.num_rows)]
            for rows, data, starts in bw.chunks([pa.record_batch([ids, batch.column(1)], names=["i", "t"])], 1_000_000):
                data = data.copy()
                data[starts[1:] - 1] = 0x0A
                begin, end, first = words_and_chains(data)
                if not len(begin):
                    continue
                post, _, _ = forward_backward(model.scores(features(folded(data), begin, end)), first, model.moves, model.starts)
                doc = np.searchsorted(starts, begin, "right") - 1
                for i, a, b, y, p in zip(rows[doc].tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist(), post.argmax(1).tolist(), post.max(1).tolist()):
                    out[i].append({"start": a, "end": b, "lang": model.langs[y], "p": min(1.0, float(p))})
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], names=["doc_id", "labels"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {id_type}, labels array<struct<start:bigint,end:bigint,lang:string,p:double>>")


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score`` for every row."""
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    names = list(dict.fromkeys(keep))
    if model is None:
        return docs.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = [c for c in names if c != "text"]  # the text goes once, however it is used: batches of texts are what a worker and its executor hold
    base = docs.select(has.alias("_has"), F.col("text").alias("_text"), *sent)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["lang_pred string", "score double"])

    def run(batches):
        model = shared.value
        for batch in batches:
            yield labelled(model, batch)
            del batch
            bw.give_back()

    def labelled(model, batch):
        ids = pa.array(np.arange(batch.num_rows))
        pred, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        read = pc.if_else(batch.column(0), batch.column(1), "")
        for rows, data, starts in bw.chunks([pa.record_batch([ids, read], names=["i", "t"])], CHUNK_BYTES):
            data = data.copy()
            data[starts[1:] - 1] = 0x0A
            begin, end, first = words_and_chains(data)
            if not len(begin):
                continue
            post, _, _ = forward_backward(model.scores(features(folded(data), begin, end)), first, model.moves, model.starts)
            doc = np.searchsorted(starts, begin, "right") - 1
            share = np.stack([np.bincount(doc, post[:, j], len(rows)) for j in range(post.shape[1])], 1)
            n = np.bincount(doc, minlength=len(rows))
            some = n > 0
            pred[rows[some]] = share[some].argmax(1)
            score[rows[some]] = (share[some].max(1) / n[some]).clip(0, 1)
        langs = np.array([*model.langs, "und"], object)
        columns = {"text": batch.column(1)} | {c: batch.column(i + 2) for i, c in enumerate(sent)}
        return pa.record_batch([*[columns[c] for c in names], pa.array(langs[pred], pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
