"""Near-duplicate detection by a chosen-path set similarity join over MinHash values.

A document is the set of its hashed shingles of words; equal sets are one vertex, with a 64-bit number of its own.
Trees of branching choose MinHash coordinates: at a node one coordinate is chosen, with chance 1/4 a second one, both
by a hash of the path so far, and a document goes on to the child named by its MinHash there. So about 1.25 children
are expected, and a pair of similarity 0.8 or more keeps at least one common child on average. Paths depend on the
document alone: levels are computed where the document is, and only (node, vertex) rows are shuffled to learn nodes'
sizes.

Nodes of at most ``LEAF`` vertices are leaves: all their pairs are compared by sketches, and a maximum spanning forest
of those that may be linked are candidates. If one of them turns out not to be linked, and its ends are of different
components, all pairs of its leaves that may be linked and are between components are candidates as well. Larger nodes
branch on. Of what is large still at the last level, as groups of copies are at every level, blocks give the links of their
maximum spanning forest by sketches. If a large node's members are not of one component after that, those outside its
main component are compared exhaustively, on full sets and block by block, with all that share such nodes with them;
only links come out, never candidates.

Candidates are confirmed on full sets, which are hashed anew from the texts of the vertices that have any. The
components come from alternating large-star and small-star steps on slim rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_pieces, release, ship
from millrace.llm.ngram import hash_words, mix
from millrace.llm.scratch import free_name, scope, stage

SHINGLE, PER_CENT = 5, 80
#: MinHash coordinates, trees, sizes of nodes that are compared at once, and levels after which nodes are measured.
COORDS, TREES, LEAF, LEVELS = 128, 14, 48, (2, 4, 6)
#: Share of equal MinHash values, as sketches tell it, from which a pair may be linked.
MAYBE = 0.64
#: Lists up to this number of rows (a few dozen bytes each) are sent to all workers; longer ones are joined by shuffle.
BROADCAST_VERTICES = 1_000_000
#: Vertices of a large node's block for the forest; those outside and all others of a block of the exhaustive part.
BLOCK, BLOCK_OUT, BLOCK_ALL = 768, 256, 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, COORDS + 1001, dtype=np.uint64))


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; shorter texts are one shingle, texts without words none."""
    hashes, counts = hash_words(texts)
    ends = np.cumsum(counts)
    coef = mix(np.arange(7, 7 + words, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes) - words + 1
    rolled = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(words if n > 0 else 0):
        rolled += hashes[j : j + n] * coef[j]
    rolled = mix(rolled)
    out = []
    for end, c in zip(ends.tolist(), counts.tolist()):
        start, c = end - c, c - 1  # without the end token
        if c >= words:
            out.append(np.unique(rolled[start : start + c - words + 1]))
        elif c:
            out.append(mix((hashes[start : start + c] * coef[:c]).sum(dtype=np.uint64) + np.arange(c, c + 1, dtype=np.uint64) * _ODD))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDS) 32-bit MinHash values; the sets must not be empty."""
    out = np.empty((len(sets), COORDS), dtype=np.uint32)
    lo = 0
    while lo < len(sets):  # pieces that stay in a core's cache
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= 1 << 16):
            n += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        at = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for k in range(COORDS):
            out[lo:hi, k] = (np.minimum.reduceat(x * _A[k] + _B[k], at) >> np.uint64(32)).astype(np.uint32)
        lo = hi
    return out


def branch(sig: np.ndarray, doc: np.ndarray, path: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, path) after so many more levels, from (document, path)."""
    for _ in range(levels):
        choice = mix(path)
        one = (choice % np.uint64(COORDS)).astype(np.int64)
        two = ((choice >> np.uint64(20)) % np.uint64(COORDS)).astype(np.int64)
        more = np.flatnonzero(((choice >> np.uint64(40)) & np.uint64(3) == 0) & (one != two))
        doc, at, path = np.concatenate([doc, doc[more]]), np.concatenate([one, two[more]]), np.concatenate([path, path[more]])
        path = mix(path * _ODD + (at.astype(np.uint64) << np.uint64(32)) + sig[doc, at])
    return doc, path


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two coordinates to a byte."""
    low = (sig & 15).astype(np.uint8)
    return (low[:, 0::2] << 4) | low[:, 1::2]


def _coords(sketches: np.ndarray) -> np.ndarray:
    """(vertices, COORDS) four-bit values."""
    return np.concatenate([sketches >> 4, sketches & 15], axis=1)


#: Equal four-bit values for similarity s: s + (1 - s) / 16 of all.
_MAYBE = (MAYBE + (1 - MAYBE) / 16) * COORDS


def vertices(rows: DataFrame, words: int) -> DataFrame:
    """id, n, d (digest of the set), and for non-empty sets sig (MinHash values) and sk (sketch), staged."""

    def fn(piece):
        sets = shingle_sets(piece.column("t").to_pylist(), words)
        full = [i for i, s in enumerate(sets) if len(s)]
        sig, sk = [None] * len(sets), [None] * len(sets)
        if full:
            got = minhash([sets[i] for i in full])
            for i, row, low in zip(full, got, _sketch(got)):
                sig[i], sk[i] = row.tobytes(), low.tobytes()
        return {"id": piece.column("id"), "n": [len(s) for s in sets], "d": [digest(s) for s in sets], "sig": sig, "sk": sk}

    return stage(map_pieces(rows, "t", fn, f"id {dict(rows.dtypes)['id']}, n bigint, d binary, sig binary, sk binary"), "near-rows")


def _signatures(batches, *names: str):
    """(MinHash values, the columns ``names``) of a few thousand rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            yield np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDS), *map(part.column, names)
    release()


def _paths(reps: DataFrame, level: int, within: list[tuple[int, np.ndarray]]) -> DataFrame:
    """(node, v) of all vertices after ``level`` levels, of those only that pass through the nodes named ``within`` levels."""
    sent = reps.sparkSession.sparkContext.broadcast(within)  # at most BROADCAST_VERTICES numbers a level

    def run(batches):
        for sig, v in _signatures(batches, "v"):
            doc = np.repeat(np.arange(len(sig)), TREES)
            path = mix(np.tile(np.arange(1, TREES + 1, dtype=np.uint64), len(sig)) * _ODD)
            done = 0
            for upto, nodes in sent.value:
                doc, path = branch(sig, doc, path, upto - done)
                keep = np.isin(path.view(np.int64), nodes)
                doc, path, done = doc[keep], path[keep], upto
            doc, path = branch(sig, doc, path, level - done)
            yield pa.RecordBatch.from_arrays([_long(path), v.take(pa.array(doc, pa.int64()))], names=["node", "v"])

    ship(reps.sparkSession)
    return reps.select("v", "sig").mapInArrow(run, "node bigint, v bigint")


def _deeper(nodes: DataFrame, big: DataFrame, reps: DataFrame, levels: int) -> DataFrame:
    """What ``_paths`` gives ``levels`` below the nodes of ``big``, by joins: for more large nodes than are sent around."""

    def run(batches):
        for sig, v, node in _signatures(batches, "v", "node"):
            doc, path = branch(sig, np.arange(len(sig)), node.to_numpy().view(np.uint64), levels)
            yield pa.RecordBatch.from_arrays([_long(path), v.take(pa.array(doc, pa.int64()))], names=["node", "v"])

    ship(reps.sparkSession)
    held = nodes.join(big.select("node"), "node").join(reps.select("v", "sig"), "v")
    return held.select("v", "node", "sig").mapInArrow(run, "node bigint, v bigint")


def _sized(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST_VERTICES rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_VERTICES + 1).count() <= BROADCAST_VERTICES else df


def _nodes(batches, *more: str):
    """(vertices, sketches, columns ``more``) of each run of equal values of the column ``k``."""
    held: list[np.ndarray] = []
    for batch in batches:
        sk = np.frombuffer(b"".join(batch.column("sk").to_pylist()), dtype=np.uint8).reshape(-1, COORDS // 2)
        now = [batch.column("k").to_numpy(), batch.column("v").to_numpy(), sk, *(batch.column(c).to_numpy() for c in more)]
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        k = held[0]
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield [x[lo:hi] for x in held[1:]]
        held = [x[edges[-1] :] for x in held] if len(k) else []  # the last run may go on
    if held:
        yield held[1:]


def _grouped(batches, *names: str):
    """Lists of the columns ``names[1:]`` for each run of equal values of the column ``names[0]``."""
    key, held = None, [[] for _ in names[1:]]
    for batch in batches:
        for k, *row in zip(*(batch.column(n).to_pylist() for n in names)):
            if k != key:
                if held[0]:
                    yield held
                key, held = k, [[] for _ in names[1:]]
            for h, x in zip(held, row):
                h.append(x)
    if held[0]:
        yield held


def _pairs_out(found, size: int = 200_000):
    """Arrow batches of pairs (a, b, forest) from arrays of them; a pair comes twice only where so many others stand between."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x)
        if n >= size:
            held = [_distinct(held)]
            n = len(held[0])
            if n >= size // 2:
                yield _pair_batch(held[0])
                held, n = [], 0
    yield _pair_batch(_distinct(held))


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    """Each pair once, as one of a forest if it is so anywhere."""
    x = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *held]), axis=0)
    return x[np.append((x[1:, :2] != x[:-1, :2]).any(axis=1), True)] if len(x) else x


def _pair_batch(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2] != 0)], names=["a", "b", "forest"])


PAIRS = "a bigint, b bigint, forest boolean"


def _cross_pairs(v: np.ndarray, sketches: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Candidates of a leaf between different components, with no forest."""
    order = np.argsort(v)
    v, root, x = v[order], root[order], _coords(sketches[order])
    same = np.stack([(x == row).sum(axis=1) for row in x])
    i, j = np.nonzero(np.triu(same >= _MAYBE, 1) & (root[:, None] != root[None, :]))
    return np.stack([v[i], v[j], np.zeros(len(i), np.int64)], axis=1)


def _forest_pairs(v: np.ndarray, sketches: np.ndarray, mark: int = 0) -> np.ndarray:
    """A maximum spanning forest, by Prim, of all pairs that may be linked by their sketches."""
    order = np.argsort(v)
    v, x = v[order], _coords(sketches[order])
    best, link, free = np.full(len(v), -1), np.zeros(len(v), dtype=np.int64), np.ones(len(v), dtype=bool)
    at, out = 0, []
    for _ in range(len(v) - 1):
        free[at] = False
        same = (x == x[at]).sum(axis=1)
        closer = free & (same > best)
        best[closer], link[closer] = same[closer], at
        at = int(np.argmax(np.where(free, best, -2)))
        if best[at] >= _MAYBE and v[link[at]] != v[at]:
            out.append((min(v[link[at]], v[at]), max(v[link[at]], v[at]), mark))
    return np.array(out, np.int64).reshape(-1, 3)


def _leaf_pairs(v: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    return _forest_pairs(v, sketches, 1)


def _compared(members: DataFrame, how, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (a, b, forest), a before b, by ``how`` in each group of (keys, v, sk, more)."""

    def run(batches):
        yield from _pairs_out(how(*x) for x in _nodes(batches, *more) if len(x[0]) > 1)
        release()

    ship(members.sparkSession)
    rows = members.withColumn("k", F.xxhash64(*keys)) if len(keys) > 1 else members.withColumn("k", F.col(keys[0]))
    return rows.repartition("k").sortWithinPartitions("k").select("k", "v", "sk", *more).mapInArrow(run, PAIRS)


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(candidates, rows (node, v) of all leaves, rows (node, v) of nodes that stayed large or None)."""
    sketches, pairs, leaves, within = reps.select("v", "sk"), None, None, []
    nodes = stage(_paths(reps, LEVELS[0], within), "near-nodes")
    for level, deeper in zip(LEVELS, [*LEVELS[1:], None]):
        sizes = stage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "near-sizes")
        small = nodes.join(_sized(sizes.where(F.col("m") <= LEAF).select("node")), "node")
        found = _compared(small.join(sketches, "v"), _leaf_pairs, "node")
        pairs, leaves = (found, small) if pairs is None else (pairs.unionByName(found), leaves.unionByName(small))
        big = sizes.where(F.col("m") > LEAF)
        n_big = big.count()
        if not n_big:
            return pairs, leaves, None
        if deeper and n_big <= BROADCAST_VERTICES and len(within) == LEVELS.index(level):
            within.append((level, np.array([r["node"] for r in big.select("node").toLocalIterator()], dtype=np.int64)))
            nodes = stage(_paths(reps, deeper, within), "near-nodes")
        elif deeper:  # the same nodes by joins
            nodes = stage(_deeper(nodes, big, reps, deeper - level), "near-nodes")
    blocks = big.select("node", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    large = stage(nodes.join(_sized(blocks), "node"), "near-large")
    block = F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int")
    # a node's first vertex stands in all its blocks, so that they can be linked
    first = large.groupBy("node").agg(F.min("v").alias("v"), F.max("blocks").alias("blocks"))
    first = first.select("node", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = large.select("node", "v", block.alias("block")).unionByName(first).join(sketches, "v")
    return pairs.unionByName(_compared(rows, _forest_pairs, "node", "block")), leaves, large.select("node", "v")


def sets_of(rows: DataFrame, wanted: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(v, s): the full sets of the vertices ``wanted``, hashed anew from the texts of ``rows``, staged.

    Only texts of rows with a wanted vertex's id reach the workers.
    """
    needed = stage(wanted.distinct().join(reps.select("v", "id", "d"), "v"), "near-needed")
    ids = needed.select(F.col("id").alias("wanted")).distinct()
    picked = rows.join(_sized(ids), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def fn(piece):
        got = {digest(s): s for s in shingle_sets(piece.column("t").to_pylist(), words)}
        return {"d": list(got), "s": [s.astype("<u8").tobytes() for s in got.values()]}

    made = map_pieces(picked.select("t"), "t", fn, "d binary, s binary")
    return stage(made.join(_sized(needed.select("v", "d")), "d").select("v", "s"), "near-sets").dropDuplicates(["v"])


def confirm(pairs: DataFrame, rows: DataFrame, reps: DataFrame, words: int, per_cent: int) -> DataFrame:
    """(a, b, forest, linked) of each candidate, staged: whether full sets have ``100 * intersection >= per_cent * union``."""
    pairs = stage(pairs.groupBy("a", "b").agg(F.max(F.col("forest").cast("int")).alias("forest")), "near-pairs")
    sets = sets_of(rows, pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))), reps, words)

    def check(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y)
                shared = both - len(np.unique(np.concatenate([x, y]))) if 100 * min(len(x), len(y)) >= per_cent * max(len(x), len(y)) else 0
                linked.append(100 * shared >= per_cent * (both - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("forest"), pa.array(linked, pa.bool_())], names=["a", "b", "forest", "linked"])
        release()

    joined = pairs.join(sets.select(F.col("v").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("v").alias("a"), F.col("s").alias("x")), "a")
    return stage(joined.select("a", "b", "forest", "x", "y").mapInArrow(check, "a bigint, b bigint, forest int, linked boolean"), "near-links")


def leaf_links(checked: DataFrame, leaves: DataFrame, found: DataFrame, rows: DataFrame, reps: DataFrame, words: int, per_cent: int) -> DataFrame | None:
    """Links (a, b) that broken forests of leaves still hide, or None if there are no such leaves.

    A forest's pair that turned out not to be linked stood for pairs of its leaves. Where its vertices are of
    different components, all pairs of these leaves between components are candidates.
    """
    root = lambda name: found.select(F.col("v").alias(name), F.col("root").alias(f"root_{name}"))
    wrong = checked.where("forest = 1 and not linked").join(root("a"), "a", "left").join(root("b"), "b", "left")
    wrong = wrong.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    wrong = stage(wrong.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "near-wrong")
    if wrong.isEmpty():
        return None
    nodes = stage(leaves.join(_sized(wrong), "v").select("node").distinct(), "near-again")
    members = leaves.join(_sized(nodes), "node").join(found, "v", "left").select("node", "v", F.coalesce("root", "v").alias("root")).join(reps.select("v", "sk"), "v")
    more = _compared(members, _cross_pairs, "node", more=("root",)).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    return confirm(more, rows, reps, words, per_cent).where("linked").select("a", "b")


def _block_links(roles: list[int], vs: list[int], roots: list[int], sets: list[bytes], per_cent: int):
    """Links between vertices outside (role 0) and all (role 1) of a block, one for each vertex outside and root."""
    every = [i for i, r in enumerate(roles) if r == 1]
    if not every:
        return
    each = [np.frombuffer(sets[i], "<u8") for i in every]
    sizes = np.array([len(x) for x in each])
    flat, at = np.concatenate(each), np.cumsum(sizes) - sizes
    for i in (i for i, r in enumerate(roles) if r == 0):
        own = np.frombuffer(sets[i], "<u8")
        shared = np.add.reduceat((own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat).astype(np.int64), at)
        done = {roots[i]}
        for j in np.flatnonzero(100 * shared >= per_cent * (len(own) + sizes - shared)).tolist():
            if roots[every[j]] not in done:
                done.add(roots[every[j]])
                yield np.array([[min(vs[i], vs[every[j]]), max(vs[i], vs[every[j]]), 1]], np.int64)


def outside_links(large: DataFrame, found: DataFrame, rows: DataFrame, reps: DataFrame, words: int, per_cent: int) -> DataFrame | None:
    """Links (a, b) that large nodes of more than one component still hide, or None if there is no such node.

    Vertices outside the main component of a node are compared, on full sets, with all vertices that share nodes of
    the same main component. Both sides are cut to blocks by hash, and only links leave a block.
    """
    at = large.join(found, "v", "left").select("node", "v", F.coalesce("root", "v").alias("root"))
    tops = at.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    mixed = stage(tops.where("roots > 1").select("node", F.col("top.root").alias("main")), "near-mixed")
    if mixed.isEmpty():
        return None
    members = stage(at.join(_sized(mixed), "node").select("main", "v", "root").distinct(), "near-open")
    chunks = members.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ALL).cast("int").alias("ca"), F.ceil(F.count(F.when(F.col("root") != F.col("main"), 1)) / BLOCK_OUT).cast("int").alias("co"))
    members = members.join(_sized(chunks), "main").join(sets_of(rows, members.select("v"), reps, words), "v")
    own = lambda n, salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, role, a, o: df.select("main", a.alias("a"), o.alias("o"), F.lit(role).alias("role"), "v", "root", "s")
    outs = members.where("root != main").withColumn("own", own("co", 2)).withColumn("each", every("ca"))
    alls = members.withColumn("own", own("ca", 1)).withColumn("each", every("co"))
    blocks = side(outs, 0, F.col("each"), F.col("own")).unionByName(side(alls, 1, F.col("own"), F.col("each"))).withColumn("k", F.xxhash64("main", "a", "o"))

    def run(batches):
        yield from _pairs_out(p for g in _grouped(batches, "k", "role", "v", "root", "s") for p in _block_links(*g, per_cent))
        release()

    found = blocks.repartition("k").sortWithinPartitions("k").select("k", "role", "v", "root", "s").mapInArrow(run, PAIRS)
    return stage(found.select("a", "b"), "near-more")


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b): root is the least vertex of its component.

    Alternates large-star (a vertex's greater neighbours go to its least neighbour) and small-star (a vertex and
    its lesser neighbours go to the least) until nothing changes, which takes about as many rounds as the
    logarithm of the longest path.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "cc")
        # xor and count of edge hashes: equal when the edges are
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a set is the distinct shingles of ``words``
    words, or the whole of a shorter text. Links: ``100 * intersection >= per_cent * union``; component_id is the
    smallest id that links lead to, and the row with that id is kept. Null text, or text without words: empty set,
    linked with nothing, component_id its own id. Null ids: reached like others, never a component's id unless it
    has no other. Repeated rows are of one component. Empty table: no rows. Other columns are not read.
    """
    with scope(df.sparkSession):
        base, label = _labels(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), words, per_cent)
    full = base.where("n > 0")
    out = full.select("id", "n", "d").join(label, "d").select("id", "n", "component_id").unionByName(base.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _labels(rows: DataFrame, words: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, d of all rows; component_id of each digest d): all else that is staged may go."""
    base = vertices(rows, words)
    full = base.where("n > 0")
    grouped = full.groupBy("d").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("sk").alias("sk"))
    reps = stage(grouped.withColumn("v", F.monotonically_increasing_id()), "near-reps")  # numbers hold as they are written
    pairs, leaves, large = candidates(reps)
    checked = confirm(pairs, rows, reps, words, per_cent)
    links = checked.where("linked").select("a", "b")
    found = stage(components(links), "near-roots")
    more = [leaf_links(checked, leaves, found, rows, reps, words, per_cent), None if large is None else outside_links(large, found, rows, reps, words, per_cent)]
    more = [x for x in more if x is not None and not x.isEmpty()]
    if more:
        for x in more:
            links = links.unionByName(x)
        found = stage(components(links), "near-roots")
    of_root = reps.select("v", "d", "id").join(found, "v", "left").select("d", "id", F.coalesce("root", "v").alias("root"))
    of_root = stage(of_root, "near-roots")
    least = of_root.groupBy("root").agg(F.min("id").alias("component_id"))
    base = stage(base.select("id", "n", "d"), "near-slim", keep=True)
    return base, stage(of_root.join(least, "root").select("d", "component_id"), "near-labels", keep=True)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """``df`` with one row of each group of near duplicates, that with the smallest id (null ids last).

    Rows are named by id and a hash of their text, so ids need not be unique; of rows that agree in both one stays.
    Rows with null text, or without words, stay, each of them. The names of dropped rows are broadcast if they are
    few, and joined by shuffle otherwise. Empty table: no rows. Columns of any name are handed on as they are.
    """
    whole, order = F.coalesce(F.col(text_col), F.lit("")), F.lpad(F.col(id_col).cast("string"), 20, "0")
    name = free_name(df, "name")
    rows = df.withColumn(name, F.concat(F.coalesce(order, F.lit("~")), F.lit(":"), F.hex(F.xxhash64(whole))))
    with scope(df.sparkSession):
        found = near_duplicates(rows.select(F.col(name).alias("name"), F.col(text_col).alias("text")), "name", "text", words, per_cent)
        found = stage(found, "near-names", keep=True)
    gone = found.where(~F.col("kept")).select(F.col("name").alias(name)).distinct()
    out = rows.join(_sized(gone), name, "left_anti")
    again = found.where("kept and n_shingles > 0").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stage(again.select(F.col("name").alias(name)), "near-again")
    if not again.isEmpty():
        out = out.join(again, name, "left_anti").unionByName(out.join(again, name, "left_semi").dropDuplicates([name]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
