"""The trie of conversations' prefixes, as a Cartesian tree over the LCP array of sorted conversations.

Equal conversations become one sequence with a number of copies first. Distinct sequences are sorted by their turns' digests,
CHUNK turns at a time: those that are still tied and have more turns are sorted on by the next chunk, so no row holds a
whole long conversation. L[u] is the number of turns that sequences u-1 and u share. Each u belongs to one inner node: depth
L[u], from the nearest smaller value on the left to the one on the right. Nearest smaller values are found in blocks of
dense positions by a stack; what a block can't tell is looked up in the nearest block whose minimum is small enough, among
the values there that nothing smaller follows. Nodes of equal depth and left end are one node. Prefix sums over positions
give members, leaves and saved text of a node, block minima its smallest conversation.

A node of depth d belongs to its leftmost sequence u, where d > L[u]; so the depths that the tree skips are expanded from the
turns of that sequence, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import bounded, stored

#: Turns of a chunk, hexadecimal digits of a turn's digest, positions of a block, members that a piece of a list holds.
CHUNK, DIGITS, BLOCK, MEMBERS = 64, 32, 1 << 16, 1 << 15
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """df with `name`: each row's place, from 0, in the order given. Ranges of the order are dealt to tasks and counted."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("__m", F.monotonically_increasing_id()), label)
    before, at = {}, 0
    for r in kept.groupBy(F.shiftright("__m", 33).alias("p")).count().orderBy("p").collect():  # one row a task
        before[r["p"]], at = at, at + r["count"]
    if not before:
        return kept.withColumn(name, F.col("__m")).drop("__m")
    start = F.element_at(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1)]), (F.shiftright("__m", 33) + 1).cast("int"))
    return kept.withColumn(name, start + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")


def rebuilt(turns: DataFrame, shared_turns: Column, group: int = 100, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c begins with the first turns of conversation c - c % group.

    shared_turns: how many, at most, as a column of `c` from 0 to 5; the conversation's own turns after its first so many
    follow. Turns go by `turn`, nulls first, equal ones by digest; rows without a conversation take no part; null roles and
    texts are empty. Gives (c, pos, digest, chars) and (c, size), conversations without turns among the latter.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(DIGITS))
    own = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    # The random number parts rows that are alike in all else: their order doesn't matter.
    own = numbered(own, [F.col("c"), F.col("t").asc_nulls_first(), F.col("digest"), F.rand(7)], "n", "turns")
    convs = own.groupBy("c").agg(F.min("n").alias("n0"), F.count("*").alias("size"))
    convs = convs.withColumn("h", shared_turns.cast("long")).withColumn("base", F.col("c") - F.col("c") % group)
    bases = convs.where(F.col("c") == F.col("base")).select(F.col("base").alias("b"), F.col("size").alias("b_size"))
    convs = convs.join(bases, F.col("base") == F.col("b"), "left").withColumn("m", F.least("h", F.coalesce("b_size", F.lit(0))))
    convs = stored(convs.select("c", "n0", "h", "base", "m", (F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    placed = own.join(convs.select("c", "n0", "h", "m"), "c").withColumn("p", F.col("n") - F.col("n0"))
    tail = placed.where("p >= h").select("c", (F.col("p") - F.col("h") + F.col("m")).alias("pos"), "digest", "chars")
    first = own.where(F.col("c") % group == 0).join(convs.select("c", "n0"), "c").select(F.col("c").alias("b"), (F.col("n") - F.col("n0")).alias("pos"), "digest", "chars").where("pos < 5")
    head = convs.where("m > 0").select("c", "base", "m").join(first, (F.col("base") == F.col("b")) & (F.col("pos") < F.col("m"))).select("c", "pos", "digest", "chars")
    return stored(tail.unionByName(head), "rebuilt"), convs.select("c", "size")


def _members(most: int):
    """Sorted (seq, c): pieces (seq, first, n, ids) of at most `most` conversations, ids in decimal with commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            out = []
            for seq, c in zip(batch["seq"].to_pylist(), batch["c"].to_pylist()):
                if ids and (seq != now or len(ids) == most):
                    out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                now = seq
                ids.append(c)
            yield _table(out, _MEMBERS)
        if ids:
            yield _table([(now, ids[0], len(ids), ",".join(map(str, ids)))], _MEMBERS)

    return run


_MEMBERS = pa.schema([("seq", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
_CLASSES = pa.schema([("seq", pa.string()), ("rep", pa.int64()), ("w", pa.int64()), ("ends", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: per sequence its smallest conversation, number of copies and the digest of all ids, streamed."""
    now, rep, w, sha = None, 0, 0, None
    for batch in batches:
        out = []
        for seq, first, n, ids in zip(*(batch[c].to_pylist() for c in ("seq", "first", "n", "ids"))):
            if seq == now:
                sha.update(b"," + ids.encode())
                w += n
                continue
            if sha is not None:
                out.append((now, rep, w, sha.hexdigest()))
            now, rep, w, sha = seq, first, n, hashlib.sha256(ids.encode())
        yield _table(out, _CLASSES)
    if sha is not None:
        yield _table([(now, rep, w, sha.hexdigest())], _CLASSES)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _shared(a: str, b: str) -> int:
    """Digests that two keys begin with alike."""
    n = min(len(a), len(b)) // DIGITS
    if a[: n * DIGITS] == b[: n * DIGITS]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGITS] == b[: mid * DIGITS] else (low, mid - 1)
    return low


_SORTED = pa.schema([("rep", pa.int64()), ("rank", pa.int64()), ("part", pa.int32()), ("i", pa.int64()), ("run", pa.int64()), ("head", pa.int64()), ("shared", pa.int64()), ("full", pa.bool_()), ("key", pa.string())])
_SORTED_DDL = "rep long, rank long, part int, i long, run long, head long, shared long, full boolean, key string"


def _scan(width: int):
    """Sorted (rank, key, rep): each row's number in its task, where its rank's and its key's rows begin (-1: maybe before
    this task), and what its key shares with the one before it. Keys stay at the first and last row alone. width: of a
    full key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, first, head, rank, key = TaskContext.get().partitionId(), 0, -1, -1, None, ""
        held: tuple | None = None  # the last row, which shows its key if no other follows
        for batch in batches:
            out = []
            for r, k, rep in zip(batch["rank"].to_pylist(), batch["key"].to_pylist(), batch["rep"].to_pylist()):
                shared = -1
                if i and r != rank:
                    first = head = i
                elif i and k != key:
                    head, shared = i, _shared(key, k)
                if held:
                    out.append(held)
                held = (rep, r, part, i, first, head, shared, len(k) == width, k if not i else None)
                rank, key, i = r, k, i + 1
            yield _table(out, _SORTED)
        if held:
            yield _table([(*held[:-1], key)], _SORTED)

    return run


def _edges(rows: DataFrame) -> tuple[dict, int]:
    """Per task: rows before it, its inherited run and head, what its first row's key shares with the one before. The driver
    gets the first and last row of each task."""
    last_rows = F.max_by(F.struct("rank", "key", "run", "head", "i"), "i").alias("last")
    found = rows.where("key is not null").groupBy("part").agg(F.min_by(F.struct("rank", "key"), "i").alias("first"), last_rows).orderBy("part").collect()
    out, at, before, run, head = {}, 0, None, 0, 0
    for r in found:
        first, last, shared = r["first"], r["last"], -1
        if before is None or before["rank"] != first["rank"]:
            run = head = at
        elif before["key"] != first["key"]:
            head, shared = at, _shared(before["key"], first["key"])
        out[r["part"]] = (at, run, head, shared)
        run, head = (run if last["run"] < 0 else at + last["run"]), (head if last["head"] < 0 else at + last["head"])
        before, at = last, at + last["i"] + 1
    return out, at


def sort_sequences(reps: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rep, u, lcp): the place of each distinct sequence, and how many turns it shares with the one before it (u = 0: -1)."""
    active, k, places, shares = reps.select("rep", F.lit(0).cast("long").alias("rank")), 0, [], []
    while True:
        own = chunks.where(F.col("k") == k).select(F.col("c").alias("rep"), "key")
        keyed = active.join(own, "rep", "left").select("rank", F.coalesce("key", F.lit("")).alias("key"), "rep")
        rows = stored(keyed.repartitionByRange("rank", "key", "rep").sortWithinPartitions("rank", "key", "rep").mapInArrow(_scan(chunk * DIGITS), _SORTED_DDL), "sorted")
        edges, total = _edges(rows)
        if not total:
            break
        size = max(edges) + 1
        of = lambda j: F.element_at(F.array(*[F.lit(edges[p][j] if p in edges else 0).cast("long") for p in range(size)]), F.col("part") + 1)  # noqa: B023, E731
        run = F.when(F.col("run") < 0, of(1)).otherwise(of(0) + F.col("run"))
        head = F.when(F.col("head") < 0, of(2)).otherwise(of(0) + F.col("head"))
        shared = F.when(F.col("i") == 0, of(3)).otherwise(F.col("shared"))
        rows = rows.select("rep", "full", (F.col("rank") + head - run).alias("u"), F.when((shared >= 0) & (of(0) + F.col("i") == head), shared + k * chunk).alias("lcp"))
        shares.append(rows.where("lcp is not null").select("u", "lcp"))
        if rows.where("full").isEmpty():
            places.append(rows.select("rep", "u"))
            break
        many = rows.where("full").groupBy("u").count().where("count > 1").select("u", F.lit(True).alias("tied"))
        rows = stored(rows.join(many, "u", "left").select("rep", "u", (F.col("full") & F.col("tied").isNotNull()).alias("tied")), "places")
        places.append(rows.where("not tied").select("rep", "u"))
        active, k = rows.where("tied").select("rep", F.col("u").alias("rank")), k + 1
        if active.isEmpty():
            break
    if not places:
        return reps.select("rep", F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("lcp")).limit(0)
    place, share = places[0], shares[0]
    for p in places[1:]:
        place = place.unionByName(p)
    for s in shares[1:]:
        share = share.unionByName(s)
    return place.join(share, "u", "left").select("rep", "u", F.coalesce("lcp", F.lit(-1)).alias("lcp"))


_SUMS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("first", pa.int64()), ("zeros", pa.int64()), ("w", pa.int64()), ("x", pa.int64()), ("leaves", pa.int64()), ("last_size", pa.int64()), ("rep", pa.int64())])
_SUMS_DDL = "block long, n long, least long, first long, zeros long, w long, x long, leaves long, last_size long, rep long"


def _sums(key: tuple, table: pa.Table) -> pa.Table:
    """One row for a block; whether its last sequence ends a branch depends on the next block."""
    table = table.sort_by("u")
    lcp, size, rep = (table[c].to_numpy() for c in ("lcp", "size", "rep"))
    return pa.Table.from_batches([_table([(key[0].as_py(), len(lcp), lcp.min(), lcp[0], (lcp == 0).sum(), table["w"].to_numpy().sum(), table["x"].to_numpy().sum(), (lcp[1:] < size[:-1]).sum(), size[-1], rep.min())], _SUMS)])


_TREE = pa.schema([(c, pa.int64()) for c in ("block", "a", "depth", "r", "over", "rep", "n_convs", "conv_id", "leaves", "x", "children", "p_a", "p_depth", "k", "left_block", "right_block", "a_lcp", "a_left", "a_size")] + [("ends", pa.string()), ("kind", pa.string())])
_TREE_DDL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _TREE)


def _smaller(lcp: list[int]) -> tuple[list[int], list[int]]:
    """Nearest smaller values on the left (-1: none here) and right (length: none here)."""
    n = len(lcp)
    left, right, stack = [-1] * n, [n] * n, []
    for i, x in enumerate(lcp):
        while stack and lcp[stack[-1]] > x:
            right[stack.pop()] = i
        j = stack[-1] if stack else -1
        left[i] = left[j] if j >= 0 and lcp[j] == x else j
        stack.append(i)
    return left, right


class _Least:
    """Minima of ranges, from tables of doubling widths."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 * (width := 1 << (len(self.rows) - 1)) <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-width], self.rows[-1][width:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first..last] for each pair; an empty range gives the largest long."""
        out = np.full(len(first), np.iinfo(np.int64).max)
        level = np.frexp(np.maximum(last - first + 1, 1))[1] - 1
        for k, row in enumerate(self.rows):
            m = (level == k) & (last >= first)
            out[m] = np.minimum(row[first[m]], row[last[m] - (1 << k) + 1])
        return out


def _tree(shared):
    """Rows of a block: nodes that lie in it, leaves' paths, parts of nodes that reach beyond, and the steps of values that
    other blocks may look up on their left and right."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sums, table = shared.value, table.sort_by("u")
        block = key[0].as_py()
        b = sums["at"][block]
        u0 = table["u"][0].as_py()
        lcp, size, w, x, pc, rep = (table[c].to_numpy() for c in ("lcp", "size", "w", "x", "pc", "rep"))
        ends, n = table["ends"].to_pylist(), len(lcp)
        after = np.concatenate([lcp[1:], [sums["first"][b + 1] if b + 1 < len(sums["first"]) else -1]])
        before = lambda a, name: sums[name][b] + np.concatenate([[0], np.cumsum(a)])
        cw, cx, cl = before(w, "w"), before(x, "x"), before(after < size, "leaves")
        low, high = np.minimum.accumulate(rep), np.minimum.accumulate(rep[::-1])[::-1]
        left, right = _smaller(lcp.tolist())
        values, rows = lcp.tolist(), []
        real = n - (size[-1] < 0)

        def row(**x: object) -> None:
            rows.append(tuple(x.get(f.name) for f in _TREE))

        def parent(above: int, below: int, at: int, own: int) -> tuple[int | None, int]:
            """Key (left end, depth) of the node over one that starts at `own`, between values above and below."""
            if max(above, below) <= 0:
                return 0, 0
            return ((u0 + left[at] if left[at] >= 0 else None), above) if above >= below else (own, below)

        nodes: dict[tuple, list[int]] = {}
        for i in range(real):
            if values[i] > 0:
                nodes.setdefault((left[i], values[i], right[i]), []).append(i)
        whole = [k for k in nodes if k[0] >= 0 and k[2] < n]
        least = _Least(rep).of(np.array([k[0] for k in whole], dtype=np.int64), np.array([k[2] - 1 for k in whole], dtype=np.int64))
        for (a, depth, r), mn in zip(whole, least.tolist()):
            p_a, p_depth = parent(values[a], values[r], a, u0 + a)
            closes = int(size[a] == depth)
            row(kind="node", block=block, a=u0 + a, depth=depth, over=max(values[a], values[r], 0), rep=int(rep[a]), n_convs=int(cw[r] - cw[a]), conv_id=mn, leaves=int(cl[r] - cl[a]), x=int(cx[r] - cx[a] - pc[a]),
                children=len(nodes[a, depth, r]) + 1 - closes, p_a=p_a, p_depth=p_depth, ends=ends[a] if closes else None)
        for i in range(real):
            over = max(values[i], int(after[i]), 0)
            if size[i] > over:
                p_a, p_depth = parent(values[i], int(after[i]), i, u0 + i)
                row(kind="node", block=block, a=u0 + i, depth=int(size[i]), over=over, rep=int(rep[i]), n_convs=int(w[i]), conv_id=int(rep[i]), leaves=1, x=int(x[i] - pc[i]), children=0, p_a=p_a, p_depth=p_depth, ends=ends[i])
        minima = sums["least"]
        for (a, depth, r), at in nodes.items():
            if a < 0 or r >= n:
                here = {} if a < 0 else {"a": u0 + a}
                here |= {} if r >= n else {"r": u0 + r}
                lb = int(np.flatnonzero(minima[:b] < depth)[-1]) if a < 0 else b
                rb = b + 1 + int(np.flatnonzero(minima[b + 1 :] < depth)[0]) if r >= n else b
                row(kind="part", block=block, depth=depth, k=len(at), left_block=sums["blocks"][lb], right_block=sums["blocks"][rb], **here)
        least_yet = np.iinfo(np.int64).max
        for i in range(n - 1, -1, -1):
            if values[i] < least_yet:
                least_yet = values[i]
                row(kind="left", block=block, a=u0 + i, a_lcp=values[i], a_left=u0 + left[i] if left[i] >= 0 else None, a_size=int(size[i]), rep=int(rep[i]), ends=ends[i], n_convs=int(cw[i]), x=int(cx[i] + pc[i]), leaves=int(cl[i]), conv_id=int(high[i]))
        least_yet = np.iinfo(np.int64).max
        for i in range(n):
            if values[i] < least_yet:
                least_yet = values[i]
                row(kind="right", block=block, r=u0 + i, a_lcp=values[i], n_convs=int(cw[i]), x=int(cx[i]), leaves=int(cl[i]), conv_id=int(low[i - 1]) if i else None)
        return pa.Table.from_batches([_table(rows, _TREE)])

    return run


def _across(tree: DataFrame, sums: dict, block_bits: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that reach over several blocks; and (block, p_depth, found): left ends that parents in a block point to."""
    spark = tree.sparkSession
    part = tree.where("kind = 'part'").select("block", "depth", "a", "r", "k", "left_block", "right_block")
    lefts = tree.where("kind = 'left'").select(F.col("block").alias("lb"), F.col("a").alias("la"), "a_lcp", "a_left", "a_size", F.col("rep").alias("rep"), "ends", F.col("n_convs").alias("lw"), F.col("x").alias("lx"), F.col("leaves").alias("ll"), F.col("conv_id").alias("lc"))
    rights = tree.where("kind = 'right'").select(F.col("block").alias("rb"), F.col("r").alias("ra"), F.col("a_lcp").alias("r_lcp"), F.col("n_convs").alias("rw"), F.col("x").alias("rx"), F.col("leaves").alias("rl"), F.col("conv_id").alias("rc"))
    # A value looked for in another block: the nearest of its steps that is smaller.
    asked = part.where("a is null").select("block", "depth", "left_block").distinct()
    found_left = asked.join(lefts.select("lb", "la", "a_lcp"), (F.col("left_block") == F.col("lb")) & (F.col("a_lcp") < F.col("depth"))).groupBy("block", "depth").agg(F.max("la").alias("found"))
    asked = part.where("r is null").select("block", "depth", "right_block").distinct()
    found_right = asked.join(rights.select("rb", "ra", "r_lcp"), (F.col("right_block") == F.col("rb")) & (F.col("r_lcp") < F.col("depth"))).groupBy("block", "depth").agg(F.min("ra").alias("found_r"))
    found_left = stored(found_left, "lefts")
    nodes = part.join(found_left, ["block", "depth"], "left").join(found_right, ["block", "depth"], "left")
    nodes = nodes.select("depth", F.coalesce("a", "found").alias("a"), F.coalesce("r", "found_r").alias("r"), "k").groupBy("a", "depth").agg(F.max("r").alias("r"), F.sum("k").alias("k"))
    nodes = nodes.join(lefts, F.col("a") == F.col("la")).join(rights, F.col("r") == F.col("ra"))
    shared = spark.sparkContext.broadcast(sums)

    @F.arrow_udf("long")
    def between(first: pa.Array, last: pa.Array) -> pa.Array:
        at, least = shared.value["at"], shared.value["rep"]
        a, b = (np.array([at[x] for x in c.to_pylist()], dtype=np.int64) for c in (first, last))
        return pa.array(_Least(np.asarray(least)).of(a + 1, b - 1))

    closes = F.col("a_size") == F.col("depth")
    below = F.greatest("a_lcp", "r_lcp") <= 0
    up = F.col("a_lcp") >= F.col("r_lcp")
    nodes = nodes.select(
        F.lit("node").alias("kind"), F.col("lb").alias("block"), "a", "depth", F.greatest("a_lcp", "r_lcp", F.lit(0)).alias("over"), "rep", (F.col("rw") - F.col("lw")).alias("n_convs"),
        F.least("lc", between("lb", "rb"), F.coalesce("rc", F.lit(2**63 - 1))).alias("conv_id"), (F.col("rl") - F.col("ll")).alias("leaves"), (F.col("rx") - F.col("lx")).alias("x"),
        (F.col("k") + 1 - closes.cast("int")).alias("children"), F.when(below, 0).when(up, F.col("a_left")).otherwise(F.col("a")).alias("p_a"), F.when(below, 0).when(up, F.col("a_lcp")).otherwise(F.col("r_lcp")).alias("p_depth"),
        F.when(closes, F.col("ends")).alias("ends"),
    )
    return nodes, found_left.select("block", F.col("depth").alias("p_depth"), "found")


_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, chunk: int = CHUNK, members: int = MEMBERS) -> DataFrame:
    """A row per distinct prefix: conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (c, pos, digest, chars), pos from 0 without gaps; convs: (c, size), all conversations once, those without turns too.
    saved_tokens: over the node's subtree, (members - 1) times `chars` of a node's last turn. ends_sha256: of the ids of
    members that end here, ascending, with commas. No conversations give no nodes.
    """
    spark, lane = bounded(turns).sparkSession, lambda i: F.sum(F.xxhash64(F.lit(i), "pos", "digest").cast("decimal(38,0)")).alias(f"s{i}")
    whole = turns.groupBy("c").agg(lane(0), lane(1), lane(2), F.sum("chars").alias("total"))
    whole = stored(convs.join(whole, "c", "left").select("c", "size", F.coalesce("total", F.lit(0)).alias("total"), F.concat_ws(".", "size", "s0", "s1", "s2").alias("seq")), "sequences")
    pieces = whole.select("seq", "c").repartitionByRange("seq", "c").sortWithinPartitions("seq", "c").mapInArrow(_members(members), "seq string, first long, n long, ids string")
    classes = pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "seq string, rep long, w long, ends string")
    reps = stored(classes.join(whole.select(F.col("c").alias("rep"), "size", "total"), "rep").select("rep", "w", "ends", "size", "total"), "classes")

    own = turns.join(reps.select(F.col("rep").alias("c")), "c", "left_semi").withColumn("k", F.floor(F.col("pos") / chunk))
    inside = Window.partitionBy("c", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("cum", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    chunks = own.groupBy("c", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "cum"))).alias("t"), F.sum("chars").alias("sum"))
    earlier = Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    chunks = stored(chunks.select("c", "k", F.array_join("t.digest", "").alias("key"), F.transform("t.cum", lambda x: x + F.col("before")).alias("cum")), "chunks")

    placed = sort_sequences(reps, chunks, chunk).join(reps, "rep").withColumn("at", F.greatest("lcp", F.lit(0)))
    lookup = chunks.select(F.col("c").alias("rep"), "k", "cum")
    placed = placed.withColumn("k", F.floor(F.col("at") / chunk)).join(lookup, ["rep", "k"], "left")
    shared_chars = F.coalesce(F.get("cum", (F.col("at") - F.col("k") * chunk).cast("int")), F.col("total"))
    placed = placed.select("u", "rep", "lcp", "w", "ends", "size", F.when(F.col("at") > 0, shared_chars).otherwise(F.lit(0)).alias("pc"), "total")
    placed = placed.withColumn("x", F.col("pc") + (F.col("w") - 1) * F.col("total")).drop("total").withColumn("block", F.floor(F.col("u") / block))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in _NODE) + ", ends_sha256 string")
    top = spark.range(1).select(F.lit(n).cast("long").alias("u"), F.lit(2**63 - 1).alias("rep"), F.lit(-1).cast("long").alias("lcp"), F.lit(0).cast("long").alias("w"), F.lit(None).cast("string").alias("ends"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("pc"), F.lit(0).cast("long").alias("x"), F.lit(n // block).cast("long").alias("block"))
    placed = stored(placed.unionByName(top), "placed")

    # One row a block of `block` sequences comes to the driver.
    found = placed.groupBy("block").applyInArrow(_sums, _SUMS_DDL).orderBy("block").collect()
    last_of = [found[i + 1]["first"] if i + 1 < len(found) else -1 for i in range(len(found))]
    leaves = [r["leaves"] + int(nxt < r["last_size"]) for r, nxt in zip(found, last_of)]
    upto = lambda a: np.concatenate([[0], np.cumsum(a)]).tolist()
    sums = {"at": {r["block"]: i for i, r in enumerate(found)}, "blocks": [r["block"] for r in found], "first": [r["first"] for r in found], "least": np.array([r["least"] for r in found]),
            "rep": [r["rep"] for r in found], "w": upto([r["w"] for r in found]), "x": upto([r["x"] for r in found]), "leaves": upto(leaves)}
    tree = stored(placed.groupBy("block").applyInArrow(_tree(spark.sparkContext.broadcast(sums)), _TREE_DDL), "tree")
    wide, ends_of = _across(tree, sums, block)
    names = ["a", "depth", "over", "rep", "n_convs", "conv_id", "leaves", "x", "children", "p_a", "p_depth", "ends", "block"]
    nodes = tree.where("kind = 'node'").select(*names).unionByName(wide.select(*names))
    nodes = nodes.join(ends_of, ["block", "p_depth"], "left").withColumn("p_a", F.coalesce("p_a", "found")).drop("found", "block")
    nodes = stored(nodes, "nodes")
    least = min(sums["rep"])
    ups = nodes.select(F.col("a").alias("p_a"), F.col("depth").alias("p_depth"), F.col("conv_id").alias("above"))
    nodes = nodes.join(ups, ["p_a", "p_depth"], "left").withColumn("above", F.when(F.col("p_depth") == 0, F.lit(least)).otherwise(F.col("above")))

    start, stop = F.floor(F.col("over") / chunk), F.floor((F.col("depth") - 1) / chunk)
    paths = nodes.withColumn("k", F.explode(F.sequence(start, stop))).join(lookup, ["rep", "k"])
    low, high = F.greatest("over", F.col("k") * chunk), F.least("depth", (F.col("k") + 1) * chunk)
    paths = paths.withColumn("d", F.explode(F.sequence(low + 1, high)))
    at_end = F.col("d") == F.col("depth")
    saved = F.col("x") - (F.col("n_convs") - 1) * F.get("cum", (F.col("d") - 1 - F.col("k") * chunk).cast("int"))
    paths = paths.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("over") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )
    first = placed.where("u = 0").first()
    empty = first["size"] == 0
    children = sum(r["zeros"] for r in found) + 1 - int(empty)
    root = [(least, 0, None, sums["w"][-1], children, sums["leaves"][-1], sums["x"][-1], first["ends"] if empty else EMPTY_SHA)]
    return paths.unionByName(spark.createDataFrame(root, ", ".join(f"{c} long" for c in _NODE) + ", ends_sha256 string"))
