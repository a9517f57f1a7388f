"""Language identification by a linear-chain conditional random field over words.

Word features: character 2- and 3-grams with word edges, affixes of three and four letters, and a lexicon of words of the
training sample. Transitions between the languages of neighbouring words are learned too, from spans of several documents
put one after the other, so that a text may switch. Forward-backward over the whole text gives every word's posterior; a
document's language has the highest mean.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import SLICE_BYTES, bounded, give_back, slices, text_bytes
from millrace.llm.encoder import blanks, offsets

BITS = 15
NONE = "und"
#: Words that one worker remembers the scores of, and the longest of them.
MEMORY, LONGEST = 150_000, 48
#: Words of a segment of a chain; labels up to which chains are cut into segments.
SEGMENT, SCAN_LABELS = 256, 12
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_EDGE = 10


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _bucket(template: int, *chars: np.ndarray) -> np.ndarray:
    h = np.full(len(chars[0]), (template + 1) * 0x51ED270B, dtype=np.uint64)
    for c, m in zip(chars, _MULT):
        h = (h ^ c) * m
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64) + (template << BITS)


class Features:
    """Feature indices of words (letters only, lower case): grams in one flat array, and up to five more per word."""

    TEMPLATES = 6

    def __init__(self, lexicon: dict[str, int]) -> None:
        self.lexicon = lexicon
        self.size = (self.TEMPLATES << BITS) + len(lexicon) + 1

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, each word's first gram and their number at the end, other features by word)"""
        s = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(n + 1) - n
        body = np.flatnonzero(s != _EDGE)
        two, three = _bucket(0, s[body], s[body + 1]), _bucket(1, s[body - 1], s[body], s[body + 1])
        grams = np.stack((two, three), axis=1).ravel()
        starts = np.concatenate(([0], np.cumsum(2 * n)))
        last, lexical = first + n - 1, np.fromiter(map(self.lexicon.get, words, itertools.repeat(0)), dtype=np.int64, count=len(words))
        pad = np.concatenate((s, np.full(4, _EDGE, dtype=np.uint64)))
        at = lambda i, least: np.where(n >= least, pad[i], np.uint64(0))
        more = np.stack([
            _bucket(2, *(at(first + i, 3) for i in range(3))), _bucket(3, *(at(last - i, 3) for i in range(3))),
            _bucket(4, *(at(first + i, 4) for i in range(4))), _bucket(5, *(at(last - i, 4) for i in range(4))),
            lexical + (self.TEMPLATES << BITS),
        ], axis=1)
        return grams, starts, more


class Model:
    """Weights of the field; scores of words are remembered per process, up to MEMORY words."""

    def __init__(self, labels: list[str], features: Features) -> None:
        self.labels, self.features = labels, features
        self.weights = np.zeros((features.size, len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))
        self._clear()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "rows", "hits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows, self.hits = np.zeros((0, len(self.labels)), dtype=np.float32), np.zeros(0, dtype=np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        grams, starts, more = self.features.of(words)
        sums = np.add.reduceat(self.weights[grams], starts[:-1], axis=0) / np.diff(starts)[:, None]
        return sums + self.weights[more].sum(axis=1)

    def scores(self, words: list[str], often: np.ndarray | None = None) -> np.ndarray:
        """exp(emission) of distinct raw words, largest 1; rows of words without a letter are 0. often: their numbers in the texts."""
        often = np.ones(len(words), dtype=np.int64) if often is None else often
        codes = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        known = codes >= 0
        rows = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        rows[known] = self.rows[codes[known]]
        self.hits[codes[known]] += often[known]
        new = np.flatnonzero(~known)
        plain = [letters(words[i]) for i in new.tolist()]
        full = np.fromiter(map(bool, plain), dtype=bool, count=len(plain))
        if full.any():
            e = self.emissions([w for w in plain if w])
            rows[new[full]] = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30.0))
        short = new[np.fromiter((len(words[i]) <= LONGEST for i in new.tolist()), dtype=bool, count=len(new))]
        if len(self.place) + len(short) > MEMORY:
            self._shed()
        if len(self.place) + len(short) <= MEMORY:
            self.place.update(zip((words[i] for i in short.tolist()), range(len(self.place), len(self.place) + len(short))))
            self.rows, self.hits = np.concatenate((self.rows, rows[short])), np.concatenate((self.hits, often[short]))
        return rows

    def _shed(self) -> None:
        """Forget the words met once since the last time; all of them if that leaves more than half."""
        keep = self.hits > 1
        if keep.sum() > MEMORY // 2:
            return self._clear()
        words = list(itertools.compress(self.place, keep.tolist()))
        self.place = dict(zip(words, range(len(words))))
        self.rows, self.hits = self.rows[keep], np.zeros(len(words), dtype=np.int64)

    def posteriors(self, emitted: np.ndarray, counts: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
        """Forward-backward over consecutive chains of `counts` words (each at least 1).

        Chains are cut into segments, all of which go a word at a time together; what enters a segment from either side
        comes from the products of the other segments' transition matrices, so a chain of a million words takes some
        thousand steps. With many labels, where products would cost more than steps, a chain is one segment.
        moved: gets the expected number of moves from label to label added (chains are then one segment each).
        """
        size, move = len(self.labels), np.exp(self.moves - self.moves.max())
        span = int(SEGMENT if moved is None and size <= SCAN_LABELS else counts.max())
        parts = -(-counts // span)
        ends = np.cumsum(parts)
        number = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
        first = np.repeat(np.cumsum(counts) - counts, parts) + number * span
        n = np.minimum(span, np.repeat(counts, parts) - number * span)
        order = np.argsort(-n, kind="stable")
        n, first, opens = n[order], first[order], (number == 0)[order]
        alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # segments with more than t words
        into, back = np.ones((len(n), size)), np.ones((len(n), size))
        if span < counts.max():
            product = np.empty((len(n), size, size))
            product[order] = self._products(emitted, first, n, opens, alive, move)
            into, back = _ends(product, ends, parts, number)
            into, back = into[order], back[order]
        forward = np.empty(emitted.shape, dtype=np.float64)
        a = into
        for t in range(n[0]):
            k = alive[t]
            at = first[:k] + t
            a = (np.where(opens[:, None], a, a @ move) if t == 0 else a[:k] @ move) * emitted[at]
            a /= a.sum(axis=1, keepdims=True)
            forward[at] = a
        b = back
        last = first + n - 1
        forward[last] *= b
        for t in range(n[0] - 2, -1, -1):
            k = alive[t + 1]
            ahead = emitted[first[:k] + t + 1] * b[:k]
            if moved is not None:
                joint = forward[first[:k] + t][:, :, None] * move * ahead[:, None, :]
                moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            x = ahead @ move.T
            x /= x.sum(axis=1, keepdims=True)
            b[:k] = x
            forward[first[:k] + t] *= x
        return forward / forward.sum(axis=1, keepdims=True)

    def _products(self, emitted: np.ndarray, first: np.ndarray, n: np.ndarray, opens: np.ndarray, alive: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Of each segment: the product of its words' matrices move * diag(emitted), scaled; a chain's first word has no move."""
        size = len(move)
        p = np.where(opens[:, None, None], np.eye(size), move) * emitted[first][:, None, :]
        for t in range(1, n[0]):
            k = alive[t]
            x = (p[:k].reshape(-1, size) @ move).reshape(k, size, size) * emitted[first[:k] + t][:, None, :]
            p[:k] = x / x.max(axis=(1, 2), keepdims=True)
        return p

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
        """Label and score of each text, and runs (start, end, label) of words with letters that have the same label."""
        words, codes, sizes = split_words([x.lower() for x in texts])
        label, score, runs = [NONE] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        rows = self.scores(words, np.bincount(codes, minlength=len(words)))[codes]
        heard = rows.any(axis=1)
        of = np.repeat(np.arange(len(texts)), sizes)[heard]
        place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[heard]
        if len(of):
            docs, begins, counts = np.unique(of, return_index=True, return_counts=True)
            p = self.posteriors(rows[heard], counts)
            mean = np.add.reduceat(p, begins, axis=0) / counts[:, None]
            best = mean.argmax(axis=1)
            score[docs] = np.clip(mean[np.arange(len(docs)), best], 0.0, 1.0)
            for d, k in zip(docs.tolist(), best.tolist()):
                label[d] = self.labels[k]
            each = p.argmax(axis=1)
            turn = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (each[1:] != each[:-1]))))
            for x, y in zip(turn.tolist(), [*turn[1:].tolist(), len(of)]):
                runs[of[x]].append((int(place[x]), int(place[y - 1]) + 1, self.labels[each[x]]))
        return label, score, runs


def _ends(product: np.ndarray, ends: np.ndarray, parts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each segment gets from the segments before it in its chain, and from those behind it."""
    into, back = np.ones(product.shape[:2]), np.ones(product.shape[:2])
    begin = ends - parts
    for k in range(1, parts.max()):
        at = begin[parts > k] + k
        x = np.einsum("si,sij->sj", into[at - 1], product[at - 1])
        into[at] = x / x.sum(axis=1, keepdims=True)
    for k in range(parts.max() - 2, -1, -1):
        at = begin[parts > k + 1] + k
        x = np.einsum("sij,sj->si", product[at + 1], back[at + 1])
        back[at] = x / x.sum(axis=1, keepdims=True)
    return into, back


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What str.split() makes of the texts: the distinct words, the number of each word in order, and how many each text has."""
    data, edges = offsets(pa.array(texts, pa.string()))
    if not len(data):
        return [], np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    blank = blanks(data)
    begins = np.concatenate(([True], blank[:-1]))
    begins[edges[:-1][edges[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins & ~blank)
    if not len(starts):
        return [], np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    # A piece goes on to the next word's first byte: the white space behind a word is cut off each distinct piece.
    at = np.concatenate((starts, [len(data)])).astype(np.int32)
    met = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
    words = [x.rstrip() for x in met.dictionary.to_pylist()]
    distinct = {x: i for i, x in enumerate(dict.fromkeys(words))}
    number = np.fromiter(map(distinct.__getitem__, words), dtype=np.int64, count=len(words))
    return list(distinct), number[met.indices.to_numpy()], np.diff(np.searchsorted(starts, edges))


def train(samples: list[tuple[str, str]], epochs: int = 6, span: int = 60, lexicon_words: int = 4000, seed: int = 1) -> Model:
    """Fit on (text, label) pairs by AdaGrad on the conditional likelihood of their words' labels.

    A chain is up to `span` words of one text and part of another's, so that changes of language are seen. Without a
    sample that has a letter the model knows no label and predicts `und`.
    """
    rng = np.random.default_rng(seed)
    spans = [([x for x in map(letters, text.lower().split()) if x], label) for text, label in samples]
    spans = [(words[:span], label) for words, label in spans if words]
    labels = sorted({label for _, label in spans})
    common = Counter(w for words, _ in spans for w in words)
    lexicon = {w: i + 1 for i, (w, c) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]) if c > 1}
    model = Model(labels, Features(lexicon))
    if not labels:
        return model
    number = {x: i for i, x in enumerate(labels)}
    of_label = Counter(label for _, label in spans)
    gw, gm = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    for epoch in range(epochs):
        order = rng.permutation(len(spans))
        other = rng.permutation(len(spans))
        for at in range(0, len(spans), 64):
            words, gold, counts, weight = [], [], [], []
            for i, j in zip(order[at : at + 64], other[at : at + 64]):
                tail = spans[j][0][: int(rng.integers(0, span // 2))]
                words += spans[i][0] + tail
                gold += [number[spans[i][1]]] * len(spans[i][0]) + [number[spans[j][1]]] * len(tail)
                counts.append(len(spans[i][0]) + len(tail))
            counts, gold = np.array(counts), np.array(gold)
            scale = np.array([len(spans) / (len(labels) * of_label[x]) for x in labels])[gold][:, None]
            grams, starts, more = model.features.of(words)
            width = np.diff(starts)
            e = np.add.reduceat(model.weights[grams], starts[:-1], axis=0) / width[:, None] + model.weights[more].sum(axis=1)
            move = np.zeros_like(model.moves)
            p = model.posteriors(np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30.0)), counts, move)
            error = p.copy()
            error[np.arange(len(gold)), gold] -= 1.0
            error *= scale
            grad = np.zeros_like(model.weights)
            np.add.at(grad, grams, np.repeat(error / width[:, None], width, axis=0))
            np.add.at(grad, more.ravel(), np.repeat(error, more.shape[1], axis=0))
            inside = np.ones(len(gold), dtype=bool)
            inside[np.cumsum(counts) - 1] = False
            t = np.flatnonzero(inside)
            np.subtract.at(move, (gold[t], gold[t + 1]), 1.0)
            grad += 1e-5 * model.weights
            gw += grad**2
            gm += move**2
            model.weights -= 0.3 * grad / np.sqrt(gw)
            model.moves -= 0.1 * move / np.sqrt(gm)
    return model


def sample(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 300, chars: int = 600, labels: int = 64) -> list[tuple[str, str]]:
    """At most per_label texts of each of at most `labels` labels, `chars` code points of each from a place hashed from its id.

    These are the bounds of the training sample: the driver gets labels * per_label * chars code points at most. Only rows
    with a label, a text, an id and `allowed` true take part; the most frequent labels (ties by name), and of each the rows
    with the smallest hash of the id (ties by id and text). train() learns from the first 60 words of each.
    """
    rows = docs.where(F.coalesce(allowed, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    mark = F.xxhash64(F.col(id_col).cast("string"))
    rows = rows.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), mark.alias("h"), F.col(text_col).alias("t"))
    most = [r["l"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(labels).collect()]
    if not most:
        return []
    rows = rows.where(F.col("l").isin(most))
    first = lambda by, *ties: F.row_number().over(Window.partitionBy(*by).orderBy("h", "i", *ties)) <= per_label
    # Ids first, without texts: at most labels * per_label rows are broadcast. A label's rows are cut down in 64 parts.
    parted = rows.select("i", "l", "h", F.pmod("h", F.lit(64)).alias("part")).distinct().withColumn("r", first(["l", "part"])).where("r")
    chosen = parted.withColumn("r", first(["l"])).where("r").select("i", "l")
    start = F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.length("t") - chars)).cast("int")
    taken = rows.join(F.broadcast(chosen), ["i", "l"]).select("i", "l", "h", F.substring("t", start, F.lit(chars)).alias("t"))
    taken = taken.withColumn("r", first(["l"], "t")).where("r")  # ids may repeat
    return [(r["t"], r["l"]) for r in sorted(taken.collect(), key=lambda r: (r["i"], r["l"], r["t"]))]


_FOUND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])


def identify(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "language", with_runs: bool = True) -> DataFrame:
    """docs with a struct `as_col` (replaced if there): lang, score (mean posterior, 0 to 1), runs of words by language.

    `und` with score 0 for null texts and texts without a letter, and if the model has no labels. Word numbers in runs
    count all white-space separated words. Other columns pass through. Texts are labelled whole, as one chain each.
    """
    shared = bounded(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,runs:array<struct<start:long,end:long,lang:string>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        try:
            for texts in batches:
                out = []
                for part in slices(pa.table({"t": texts}), "t", SLICE_BYTES):
                    raw = [x.decode() for x in text_bytes(part["t"])]
                    label, score, runs = model.predict(raw) if model.labels else ([NONE] * len(raw), np.zeros(len(raw)), [[]] * len(raw))
                    out += [{"lang": x, "score": float(s), "runs": [{"start": a, "end": b, "lang": c} for a, b, c in r] if with_runs else None} for x, s, r in zip(label, score, runs)]
                yield pa.array(out, _FOUND)
        finally:
            model._clear()
            give_back()

    return docs.withColumn(as_col, run(F.col(text_col).cast("string")))
