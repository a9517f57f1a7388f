"""Benchmark decontamination with a generalised suffix automaton over the words of normalised test items.

A document's words stream through the automaton, which tracks the longest match that ends at each word. A match of
`window` words or more covers all of its words; an item with fewer words counts as one window. Items are packed into
blocks of at most `block_words` words; each block's automaton is broadcast and meets every document in its own pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bounded, stored, text_bytes

#: A word byte to itself, A-Z to a-z, any other byte to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_DDL = "struct<n_words:long,longest:long,spans:array<struct<start:long,end:long>>,items:array<string>>"


def normal_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased."""
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Every run of words of every item, with the items of each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = 13) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        sequences = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        self.size = max(1, len(self.vocab))
        self.go: dict[int, int] = {}
        self.link, self.length, edges = [-1], [0], [[]]
        self._edges: list[list[int]] = edges
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.least = min((min(len(s), window) for _, s in sequences), default=0)
        owners: list[set[str]] = [set() for _ in self.link]
        shorts: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for name, seq in sequences:
            v = 0
            for c in seq:
                u = v = self.go[v * self.size + c]
                while u > 0 and name not in owners[u]:
                    owners[u].add(name)
                    u = self.link[u]
            if len(seq) < window:
                while self.length[self.link[v]] >= len(seq):
                    v = self.link[v]
                shorts[v].append((len(seq), name))
        #: By state: items that have the last `window` words; (length, item) of the short items that end here.
        self.long_items: list[frozenset[str]] = [frozenset()] * len(self.link)
        self.short_items: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            self.short_items[v] = self.short_items[up] + tuple(shorts[v])
            if self.length[v] >= window:
                self.long_items[v] = self.long_items[up] if self.length[up] >= window else frozenset(owners[v])
        del self._edges

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        v = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self._edges.append([])
        for c in self._edges[like] if like is not None else ():
            self._set(v, c, self.go[like * self.size + c])
        return v

    def _set(self, v: int, c: int, to: int) -> None:
        if v * self.size + c not in self.go:
            self._edges[v].append(c)
        self.go[v * self.size + c] = to

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = copy
        while p >= 0 and self.go.get(p * self.size + c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.go.get(last * self.size + c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and p * self.size + c not in self.go:
            self._set(p, c, cur)
            p = self.link[p]
        if p >= 0:
            q = self.go[p * self.size + c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def match(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Longest match, merged hit spans [start, end) and items with a window that occurs."""
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        edge = np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        enough = ends - begins >= max(1, self.least)  # no window fits a shorter run of known words
        longest, spans, items = 0, [], set()
        go, link, length, size, window = self.go, self.link, self.length, self.size, self.window
        for a, b in zip(begins[enough].tolist(), ends[enough].tolist()):
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while (to := go.get(v * size + c)) is None and v:
                    v = link[v]
                    n = length[v]
                if to is not None:
                    v, n = to, n + 1
                longest = max(longest, n)
                start = i
                if n >= window:
                    items |= self.long_items[v]
                    start = i - n
                for k, name in self.short_items[v]:
                    if k <= n:
                        items.add(name)
                        start = min(start, i - k)
                if start < i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return longest, spans, items


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over consecutive items; the driver holds one block at a time."""
    held, count = [], 0
    for name, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = normal_words((text or "").encode())
        if held and count + len(words) > block_words:
            yield SuffixAutomaton(held, window)
            held, count = [], 0
        held.append((name or "", words))
        count += len(words)
    yield SuffixAutomaton(held, window)


def _matcher(docs: DataFrame, automaton: SuffixAutomaton):
    shared = bounded(docs).sparkSession.sparkContext.broadcast(automaton)

    @F.arrow_udf(_DDL)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for text in text_bytes(pa.chunked_array([texts])):
            words = normal_words(text)
            longest, spans, items = shared.value.match(words)
            rows.append({"n_words": len(words), "longest": longest, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
        return pa.array(rows, _FOUND)

    return found


def _merged(spans: str) -> str:
    """SQL that merges sorted, overlapping or touching spans."""
    return (
        f"aggregate(array_sort({spans}), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1).end >= x.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))), "
        "concat(acc, array(x))))"
    )


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, coverage: tuple[int, int] = (1, 20), longest: int | None = None, block_words: int = 200_000, as_col: str = "match",
) -> DataFrame:
    """docs with a struct column `as_col` (replaced if there): n_words, longest (match length), spans of hit words, items
    (ids, as sorted strings), n_hit, contaminated (a hit, and hit words make up the share `coverage` of all, or a match exceeds `longest`).

    Null and blank texts have no words and no hits; null or blank items have no windows; a null item id counts as ''.
    Items that repeat an id count once. Empty tables give no hits. Texts are read whole.
    """
    parts = iter(blocks(items, item_id_col, item_text_col, window, block_words))
    first, second = next(parts), next(parts, None)
    if second is None:
        out = docs.withColumn(as_col, _matcher(docs, first)(F.col(text_col).cast("string")))
    else:
        keys = {"__id": F.col(id_col), "__text": F.sha2(F.col(text_col).cast("string"), 256)}
        keyed, hits = docs.withColumns(keys), None
        for automaton in itertools.chain((first, second), parts):
            own = keyed.select("__id", "__text", _matcher(docs, automaton)(F.col(text_col).cast("string")).alias("m")).where("size(m.items) > 0 or m.longest > 0")
            own = stored(own.dropDuplicates(["__id", "__text"]), "matches")
            hits = own if hits is None else hits.unionByName(own)
        all_of = lambda f: F.flatten(F.collect_list(f))
        hits = hits.groupBy("__id", "__text").agg(F.max("m.longest").alias("longest"), all_of("m.spans").alias("spans"), F.array_sort(F.array_distinct(all_of("m.items"))).alias("items"))
        hits = hits.withColumn("spans", F.expr(_merged("spans"))).withColumnsRenamed({"__id": "__id2", "__text": "__text2"})
        none = SuffixAutomaton([], window)
        counted = keyed.withColumn("__n", _matcher(docs, none)(F.col(text_col).cast("string"))["n_words"])
        out = counted.join(hits, F.col("__id").eqNullSafe(F.col("__id2")) & F.col("__text").eqNullSafe(F.col("__text2")), "left")
        empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
        out = out.withColumn(as_col, F.struct(F.col("__n").alias("n_words"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))
        out = out.select(*[c for c in docs.columns if c != as_col], as_col)
    m = F.col(as_col)
    hit = F.aggregate(m["spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    out = out.withColumn(as_col, m.withField("n_hit", hit))
    over = (m["n_hit"] > 0) & (coverage[1] * m["n_hit"] >= coverage[0] * m["n_words"])
    over = over | (m["longest"] > longest) if longest is not None else over
    return out.withColumn(as_col, m.withField("contaminated", over))


def remove_spans(matched: DataFrame, text_col: str = "text", as_col: str = "match", least: int = 1) -> DataFrame:
    """matched with hit spans of `least` words or more cut out of the text; other bytes stay as they are."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            own = [x for x in own or [] if x["end"] - x["start"] >= least]
            if text is None or not own:
                out.append(text)
                continue
            raw = text.encode()
            edge = np.diff(np.concatenate(([0], (np.frombuffer(raw.translate(_NORMAL), dtype=np.uint8) != 32).astype(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept, at = [], 0
            for x in own:
                kept.append(raw[at : begin[x["start"]]])
                at = end[x["end"] - 1]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return matched.withColumn(text_col, cut(F.col(text_col), F.col(as_col)["spans"]))
