"""Language-model scoring: an interpolated modified Kneser-Ney model of order 2 or 3.

Counted in Spark: workers hash words to 64 bits with array operations, count a few million at a time, and pass on
sorted, packed runs by hash range; the ranges are merged in parallel. The model is sorted hash arrays in files of
the shared folder, which workers map into memory: words (hash, count, and how many different words follow once,
twice, oftener, and come before) and pairs (hash, count). A pair's hash is a bijection of the two words' places in
the word array, so ranges are even whatever the words' frequencies, and a pair's words can be had back.

With order 3 the same is done once more: a triple's hash is a bijection of the places of a pair and a word. Pairs then
count by how many different words stand before them (those at the beginning of a text by how often they occur).
"""

from __future__ import annotations

import mmap
import struct
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import built, map_pieces, pieces, release, ship
from millrace.llm.scratch import fresh_path, list_files, scope, stage

#: Tokens that a worker counts before it passes them on; bytes of text that are hashed at once.
FLUSH_TOKENS, PIECE = 3_000_000, 1 << 20
#: Input of a hash range, by the plan's estimate, and the most ranges that a worker's runs are cut to.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16
FILE_END = "/MRLM\n\n\n"  # eight bytes, so that arrays stay aligned
BOS = np.uint64(0xFFFFFFFF)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return x ^ (x >> np.uint64(33))


END = mix(np.array([0xE0D], dtype=np.uint64))[0]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        x = np.full(size, _BASE, dtype=np.uint64)
        x[0] = 1
        _POWERS[0] = np.multiply.accumulate(x)
    return _POWERS[0]


def hash_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, number of tokens of each text). Words are runs of ``[^\\x20\\x09-\\x0D]`` after
    lower-casing A-Z; each text has one end token more."""
    raws = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    size = np.array([len(r) + 1 for r in raws], dtype=np.int64)
    data = np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8)
    del raws
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, length = edge[0::2], edge[1::2] - edge[0::2]
    owner = np.searchsorted(np.cumsum(size), starts, side="right")
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    if starts.size:
        # places in a word as 32-bit numbers: a piece is far smaller than 2 GB, and most of the memory here is per byte
        place = np.arange(data.size, dtype=np.uint32)
        place -= np.repeat(np.concatenate([[0], starts]).astype(np.uint32), np.diff(np.concatenate([[0], starts, [data.size]])))
        place[blank] = 0
        x = _powers(int(length.max()) + 1)[place]
        del place
        np.multiply(x, data.astype(np.uint16) + np.uint16(1), out=x, casting="unsafe")
        x[blank] = 0
        hashes = mix(np.add.reduceat(x, starts) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    out = np.empty(len(hashes) + len(texts), dtype=np.uint64)
    ends = np.cumsum(counts + 1) - 1
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = hashes
    return out, counts + 1


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, and 32-bit values beside them, by byte planes."""
    import zstandard

    diff = np.diff(keys, prepend=np.uint64(0))
    return struct.pack("<II", len(keys), len(values)) + zstandard.compress(b"".join([_planes(diff), *[_planes(v.astype(np.uint32)) for v in values]]), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n, k = struct.unpack_from("<II", blob)
    raw = zstandard.decompress(blob[8:])
    get = lambda at, width, kind: np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
    return [np.cumsum(get(0, 8, np.uint64), dtype=np.uint64), *[get(8 * n + 4 * n * i, 4, np.uint32) for i in range(k)]]


def count(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often, or the sums of ``weights`` (columns of 32-bit values)."""
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[at], np.diff(at, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[at], np.add.reduceat(weights[order].astype(np.int64), at, axis=0) if len(at) else weights[:0].astype(np.int64)


def by_range(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Slices of sorted hashes by bucket: the bucket of a hash is its share of the 64-bit range."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(b, slice(lo, hi)) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])


def _counted(docs: DataFrame, buckets: int, keys_of) -> DataFrame:
    """Packed runs (bucket, blob) of the keys that ``keys_of(hashes, token counts)`` makes of the texts ``t``."""
    ship(docs.sparkSession)

    def counted(held: np.ndarray):
        held.sort()
        at = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        sizes = np.diff(at, append=len(held)).astype(np.uint32)
        keys = held[at]
        del at
        return _rows([(b, pack(keys[s], sizes[s])) for b, s in by_range(keys, buckets)])

    def run(batches):
        held, n = np.empty(FLUSH_TOKENS, dtype=np.uint64), 0
        for batch in batches:
            for piece in pieces(batch, "t", PIECE):
                got = keys_of(*hash_words(piece.column("t").to_pylist()))
                while len(got):
                    part, got = got[: FLUSH_TOKENS - n], got[FLUSH_TOKENS - n :]
                    held[n : n + len(part)] = part
                    n += len(part)
                    if n == FLUSH_TOKENS:
                        yield counted(held)
                        n = 0
        if n:
            yield counted(held[:n])
        del held
        release()

    return docs.select("t").mapInArrow(run, "bucket int, blob binary")


def _merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums of their values) of packed runs; a column per value."""
    got = [unpack(b) for b in blobs]
    return count(np.concatenate([g[0] for g in got]), np.concatenate([np.stack(g[1:], axis=1) for g in got]))


def _by_bucket(batches):
    """bucket -> blobs of one partition, in order."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            held.setdefault(b, []).append(blob)
    return sorted(held.items())


def _write(df: DataFrame, path: str) -> None:
    df.select(F.col("value").cast("string").alias("value")).write.option("lineSep", FILE_END).text(path)


def _record(bucket: int, *arrays: np.ndarray) -> bytes:
    """Bucket, length, then 64-bit arrays (as many as given) of one length."""
    return struct.pack("<QQ", bucket, len(arrays[0])) + b"".join(a.astype("<u8").tobytes() for a in arrays)


class Files:
    """Records of written files, mapped into memory: bucket -> arrays."""

    def __init__(self, paths: list[str], columns: int):
        self.of: dict[int, list[np.ndarray]] = {}
        self.size = {}
        for path in paths:
            with open(path, "rb") as f:
                if not f.seek(0, 2):
                    continue
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            at = 0
            while at < len(data):
                bucket, n = struct.unpack_from("<QQ", data, at)
                self.of[bucket] = [np.frombuffer(data, "<u8", n, at + 16 + 8 * n * i) for i in range(columns)]
                at += 16 + 8 * n * columns + len(FILE_END)

    def places(self, keys: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For hashes in any order: their places over all buckets, -1 if not there, and their counts."""
        order = np.argsort(keys)
        place, count = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for b, s, at, hit in self.find(keys[order], len(starts)):
            place[order[s]] = np.where(hit, at + starts[b], -1)
            count[order[s]] = np.where(hit, self.of[b][1][at].astype(np.int64), 0)
        return place, count

    def at(self, places: np.ndarray, starts: list[int], columns: int) -> np.ndarray:
        """(places, columns): what stands at places over all buckets; zeros where a place is negative."""
        out, order = np.zeros((len(places), columns), dtype=np.int64), np.argsort(places, kind="stable")
        edges = np.searchsorted(places[order], np.array([*starts, 1 << 62], dtype=np.int64))
        for b, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if hi > lo and b in self.of:
                own = order[lo:hi]
                for k in range(columns):
                    out[own, k] = self.of[b][k][places[own] - starts[b]].astype(np.int64)
        return out

    def find(self, keys: np.ndarray, buckets: int):
        """For sorted hashes: (bucket, slice of them, places in the bucket, which are there)."""
        for b, s in by_range(keys, buckets):
            if b in self.of:
                held = self.of[b][0]
                at = np.minimum(np.searchsorted(held, keys[s]), len(held) - 1)
                yield b, s, at, held[at] == keys[s]


class Words:
    """Places of words in the array of all words of the training texts."""

    def __init__(self, paths: list[str], starts: list[int]):
        self.files, self.starts = Files(paths, 2), starts

    def ids(self, hashes: np.ndarray, with_counts: bool = False):
        """Place of each word, -1 if unknown (and its count)."""
        keys, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for b, s, at, hit in self.files.find(keys, len(self.starts)):
            ids[s] = np.where(hit, at + self.starts[b], -1)
            counts[s] = np.where(hit, self.files.of[b][1][at].astype(np.int64), 0)
        return (ids[back], counts[back]) if with_counts else ids[back]


def _pairs(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token's pair of (word before, word); the first of a text follows BOS."""
    before = np.empty(len(ids), dtype=np.uint64)
    before[1:] = ids[:-1].astype(np.uint64)
    before[np.cumsum(counts) - counts] = BOS
    return mix((before << np.uint64(32)) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)))


def _triples(ids: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token's triple of (pair of the two words before, word); a text's first one follows BOS alone."""
    before = np.empty(len(ids), dtype=np.uint64)
    before[1:] = pairs[:-1].astype(np.uint64)
    before[np.cumsum(counts) - counts] = BOS
    return mix((before << np.uint64(32)) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)))


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places that a pair's or triple's hash is made of."""
    both = unmix(keys)
    return (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)


def _kinds(groups: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct groups in order, and of each how many sizes are 1, 2, and 3 or more, and their sum."""
    order = np.argsort(groups, kind="stable")
    groups, size = groups[order], size[order]
    at = np.flatnonzero(np.diff(groups, prepend=~groups[:1]))
    if not len(at):
        return groups, [size] * 4
    capped = np.minimum(size, 3)
    return groups[at], [*(np.add.reduceat(capped == k, at, dtype=np.int64) for k in (1, 2, 3)), np.add.reduceat(size, at)]


def _ranged(places: np.ndarray, columns: list[np.ndarray], starts: list[int]):
    """(range, packed places and columns) of sorted places by the ranges that they are in; BOS is range -1."""
    n = len(places) - int(len(places) and places[-1] == BOS)
    cuts = [0, *np.searchsorted(places[:n], np.array(starts[1:], dtype=np.uint32)).tolist(), n]
    for b, lo, hi in [*zip(range(len(starts)), cuts, cuts[1:]), (-1, n, len(places))]:
        if hi > lo:
            yield b, pack(places[lo:hi].astype(np.uint64), *[c[lo:hi] for c in columns])


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of keys with count 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(out, (1, 2, 3))]


def _local(spark, path: str) -> list[str]:
    """Names under which workers open the files of a folder: themselves on a shared mount, else fetched copies."""
    names = list_files(spark, path)
    if all(urlparse(p).scheme in ("", "file") for p in names):
        return [unquote(urlparse(p).path) for p in names]
    for p in names:
        spark.sparkContext.addFile(p)
    return ["sparkfiles:" + p.rsplit("/", 1)[-1] for p in names]


def _open(names: list[str]) -> list[str]:
    from pyspark import SparkFiles

    return [SparkFiles.get(n.removeprefix("sparkfiles:")) if n.startswith("sparkfiles:") else n for n in names]


def ranges_for(docs: DataFrame) -> int:
    """Number of hash ranges: by the size of what the plan reads, else by the session's shuffle partitions."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size >= 1 << 60:  # not known
        return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(MOST_RANGES, max(8, size // RANGE_BYTES + 1))


def train(texts: DataFrame, text_col: str = "text", order: int = 2) -> dict:
    """Count a model over all of ``texts``; the result names its files and small numbers, and can be broadcast.

    A few rows per hash range reach the driver. Null counts as empty.
    """
    with scope(texts.sparkSession):  # of tables that the files are written from
        if order not in (2, 3):
            raise ValueError("the order is 2 or 3")
        model = _train(texts, text_col)
        return _train_triples(texts, text_col, model) if order == 3 else model


def _train(texts: DataFrame, text_col: str) -> dict:
    spark = texts.sparkSession
    ship(spark)
    docs = texts.select(F.col(text_col).alias("t"))
    buckets = ranges_for(docs)
    top = fresh_path(spark, "ngram")

    def merge_words(batches):
        for b, blobs in _by_bucket(batches):
            keys, c = _merge(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(keys)]), pa.array([int(c.sum())]), pa.array([_record(b, keys, c[:, 0])], pa.binary())], names=["bucket", "n", "total", "value"])

    words = stage(_counted(docs, buckets, lambda h, c: h).repartitionById(buckets, F.col("bucket")).mapInArrow(merge_words, "bucket int, n bigint, total bigint, value binary"), "ngram-words")
    sizes = {r["bucket"]: r for r in words.select("bucket", "n", "total").collect()}
    _write(words, f"{top}/words")
    starts, n_words, n_tokens = [], 0, 0
    for b in range(buckets):
        starts.append(n_words)
        if b in sizes:
            n_words, n_tokens = n_words + sizes[b]["n"], n_tokens + sizes[b]["total"]
    if n_words >= int(BOS):
        raise ValueError("a pair's key has 32 bits for a word's place: 4,294,967,294 different words at most")
    names = _local(spark, f"{top}/words")
    sent, tag = spark.sparkContext.broadcast((names, starts)), uuid.uuid4().hex

    def pairs_of(hashes, counts):
        words = built(tag, lambda: Words(_open(sent.value[0]), sent.value[1]))
        return _pairs(words.ids(hashes), counts)

    def merge_pairs(batches):
        edges = np.array(sent.value[1][1:], dtype=np.uint32)
        for b, blobs in _by_bucket(batches):
            keys, c = _merge(blobs)
            c = c[:, 0]
            both = unmix(keys)
            before, word = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
            del both
            size = np.minimum(c, 3)
            order = np.argsort(before)
            before, of = before[order], size[order]
            at = np.flatnonzero(np.diff(before, prepend=~before[:1]))
            kinds = [np.add.reduceat(of == k, at, dtype=np.int64) for k in (1, 2, 3)] if len(at) else []
            ids = before[at]
            cuts = [0, *np.searchsorted(ids, edges).tolist(), len(ids)]
            if len(ids) and ids[-1] == BOS:  # BOS in a bucket of its own
                cuts[-1] -= 1
                yield _stat(-1, 0, [], pack(ids[-1:].astype(np.uint64), *[v[-1:] for v in kinds], np.zeros(1, np.uint32)))
            for w, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    yield _stat(w, 0, [], pack(ids[lo:hi].astype(np.uint64), *[v[lo:hi] for v in kinds], np.zeros(hi - lo, np.uint32)))
            ids, n = count(word)
            none = np.zeros(len(ids), np.uint32)
            cuts = [0, *np.searchsorted(ids, edges).tolist(), len(ids)]
            for w, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    yield _stat(w, 0, [], pack(ids[lo:hi].astype(np.uint64), *[none[lo:hi]] * 3, n[lo:hi]))
            yield _stat(b, 1, [int((c == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)], _record(b, keys, c))

    def _stat(bucket, kind, numbers, value):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([numbers], pa.list_(pa.int64())), pa.array([value], pa.binary())], names=["bucket", "kind", "numbers", "blob"])

    # the pairs' records and, as packed partial sums by range of words, what they say of their words
    pairs = stage(_counted(docs, buckets, pairs_of).repartitionById(buckets, F.col("bucket")).mapInArrow(merge_pairs, "bucket int, kind int, numbers array<bigint>, blob binary"), "ngram-pairs")
    _write(pairs.where("kind = 1").select(F.col("blob").alias("value")), f"{top}/pairs")
    numbers = {r["bucket"]: r["numbers"] for r in pairs.where("kind = 1").select("bucket", "numbers").collect()}
    seen = list(numbers.values())
    pair_starts = [sum(numbers[k][4] for k in numbers if k < b) for b in range(buckets)]
    coc = [sum(x[k] for x in seen) for k in range(4)]
    n_pairs = sum(x[4] for x in seen)
    bos = np.zeros(4, dtype=np.int64)
    for r in pairs.where("kind = 0 and bucket = -1").select("blob").collect():  # one row per range
        bos += np.array([int(v[0]) for v in unpack(r["blob"])[1:]])

    def merge_stats(batches):
        for b, blobs in _by_bucket(batches):
            n, start = sent.value[1][b + 1 : b + 2] or [n_words], sent.value[1][b]
            dense = np.zeros((n[0] - start, 4), dtype=np.int64)
            for ids, *vals in map(unpack, blobs):  # each word once in a blob
                for k, v in enumerate(vals):
                    dense[ids.astype(np.int64) - start, k] += v
            numbers = [int((dense[:, 3] == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([numbers], pa.list_(pa.int64())), pa.array([_record(b, *dense.T)], pa.binary())], names=["bucket", "numbers", "value"])

    stats = stage(pairs.where("kind = 0 and bucket >= 0").select("bucket", "blob").repartitionById(buckets, F.col("bucket")).mapInArrow(merge_stats, "bucket int, numbers array<bigint>, value binary"), "ngram-stats")
    _write(stats, f"{top}/stats")
    cont = [sum(r["numbers"][k] for r in stats.select("numbers").collect()) for k in range(4)]
    n_docs = docs.count()
    return {
        "words": names, "pairs": _local(spark, f"{top}/pairs"), "stats": _local(spark, f"{top}/stats"), "starts": starts, "buckets": buckets, "pair_starts": pair_starts, "order": 2, "top": top,
        "n_words": n_words, "n_tokens": n_tokens, "n_pairs": n_pairs, "n_docs": n_docs, "bos": bos.tolist(), "d2": discounts(coc), "d1": discounts(cont), "cont": cont,
    }


def _train_triples(texts: DataFrame, text_col: str, model: dict) -> dict:
    """``model`` with triples: their counts, what they say of pairs, and what those say of words."""
    spark, docs = texts.sparkSession, texts.select(F.col(text_col).alias("t"))
    buckets, top = model["buckets"], model["top"]
    if model["n_pairs"] >= int(BOS):
        raise ValueError("a triple's key has 32 bits for a pair's place: 4,294,967,294 different pairs at most")
    sent, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # file names and a few numbers per hash range
    both = lambda: (Words(_open(sent.value["words"]), sent.value["starts"]), Files(_open(sent.value["pairs"]), 2))
    schema, kinds = "bucket int, kind int, numbers array<bigint>, blob binary", [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, kinds)], names=["bucket", "kind", "numbers", "blob"])

    def triples_of(hashes, counts):
        words, pairs = built(tag, both)
        ids = words.ids(hashes)
        return _triples(ids, pairs.places(_pairs(ids, counts), sent.value["pair_starts"])[0], counts)

    def merge_triples(batches):
        pairs, starts = built(tag, both)[1], sent.value["pair_starts"]
        for b, blobs in _by_bucket(batches):
            keys, c = _merge(blobs)
            c = c[:, 0]
            before, word = _halves(keys)
            ids, columns = _kinds(before, c)
            none = np.zeros(len(ids), np.int64)
            for w, blob in _ranged(ids, [*columns[:3], none], starts):  # what follows a pair
                yield row(w, 0, [], blob)
            held = np.flatnonzero(before != BOS)  # pairs at the beginning of a text have nothing before them
            first = pairs.at(before[held].astype(np.int64), starts, 1)[:, 0].view(np.uint64)
            own = (_halves(first)[1].astype(np.uint64) << np.uint64(32)) | word[held].astype(np.uint64)
            ids, n = count(pairs.places(mix(own), starts)[0].astype(np.uint32))
            none = np.zeros(len(ids), np.int64)
            for w, blob in _ranged(ids, [none, none, none, n], starts):  # what stands before a pair
                yield row(w, 0, [], blob)
            yield row(b, 1, [int((c == k).sum()) for k in (1, 2, 3, 4)], _record(b, keys, c))

    made = _counted(docs, buckets, triples_of).repartitionById(buckets, F.col("bucket")).mapInArrow(merge_triples, schema)
    made = stage(made, "ngram-triples")
    _write(made.where("kind = 1").select(F.col("blob").alias("value")), f"{top}/triples")
    coc = [sum(r["numbers"][k] for r in made.where("kind = 1").select("numbers").collect()) for k in range(4)]

    def merge_pair_stats(batches):
        pairs, starts = built(tag, both)[1], sent.value["pair_starts"]
        for b, blobs in _by_bucket(batches):
            keys, c = pairs.of[b]
            before = _halves(keys)[0]
            dense = _dense(blobs, starts[b], len(keys))
            dense[:, 3] = np.where(before == BOS, c.astype(np.int64), dense[:, 3])
            ids, columns = _kinds(before, dense[:, 3])
            for w, blob in _ranged(ids, columns, sent.value["starts"]):
                yield row(w, 0, [], blob)
            yield row(b, 1, [int((dense[:, 3] == k).sum()) for k in (1, 2, 3, 4)], _record(b, *dense.T))

    parts = made.where("kind = 0 and bucket >= 0").select("bucket", "blob")
    # every range of pairs has a row, also one that no triple says anything of
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(_packed_none()).alias("blob"))
    every = every.where(F.col("bucket").isin([int(b) for b in range(buckets) if ([*model["pair_starts"], model["n_pairs"]][b + 1] > model["pair_starts"][b])]))
    stats = stage(parts.unionByName(every).repartitionById(buckets, F.col("bucket")).mapInArrow(merge_pair_stats, schema), "ngram-pair-stats")
    _write(stats.where("kind = 1").select(F.col("blob").alias("value")), f"{top}/pair-stats")
    adjusted = [sum(r["numbers"][k] for r in stats.where("kind = 1").select("numbers").collect()) for k in range(4)]
    bos = np.zeros(4, dtype=np.int64)
    for r in stats.where("kind = 0 and bucket = -1").select("blob").collect():  # one row per range
        bos += np.array([int(v[0]) for v in unpack(r["blob"])[1:]])

    def merge_contexts(batches):
        starts = [*sent.value["starts"], sent.value["n_words"]]
        for b, blobs in _by_bucket(batches):
            yield row(b, 1, [], _record(b, *_dense(blobs, starts[b], starts[b + 1] - starts[b]).T))

    contexts = stats.where("kind = 0 and bucket >= 0").select("bucket", "blob").repartitionById(buckets, F.col("bucket")).mapInArrow(merge_contexts, schema)
    _write(contexts.select(F.col("blob").alias("value")), f"{top}/contexts")
    return model | {
        "order": 3, "triples": _local(spark, f"{top}/triples"), "pair_stats": _local(spark, f"{top}/pair-stats"), "contexts": _local(spark, f"{top}/contexts"),
        "d3": discounts(coc), "d2": discounts(adjusted), "d2_raw": model["d2"], "bos": bos.tolist(), "bos_raw": model["bos"],
    }


def _packed_none() -> bytes:
    return pack(np.zeros(0, np.uint64), *[np.zeros(0, np.uint32)] * 4)


def _dense(blobs: list[bytes], start: int, n: int) -> np.ndarray:
    """(places, 4): sums of packed columns by place, for a range of places."""
    out = np.zeros((n, 4), dtype=np.int64)
    for ids, *columns in map(unpack, blobs):  # each place once in a blob
        for k, v in enumerate(columns):
            out[ids.astype(np.int64) - start, k] += v
    return out


class Scorer:
    def __init__(self, model: dict):
        self.m = model
        if model["order"] == 3:
            self.triples, self.pair_stats, self.contexts = Files(_open(model["triples"]), 2), Files(_open(model["pair_stats"]), 4), Files(_open(model["contexts"]), 4)
        self.words = Words(_open(model["words"]), model["starts"])
        self.pairs, self.stats = Files(_open(model["pairs"]), 2), Files(_open(model["stats"]), 4)
        d1, (n1, n2, n3, _) = model["d1"], model["cont"]
        more = model["n_words"] - n1 - n2
        self.total = max(1, model["n_pairs"])
        # what the discounts free of the continuation counts goes to all words and the unknown one alike
        self.free = (d1[0] * n1 + d1[1] * n2 + d1[2] * max(0, more)) / self.total if model["n_pairs"] else 1.0
        self.even = self.free / (model["n_words"] + 1)

    def score(self, texts: list) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, score (log10 of the model's probability)."""
        m = self.m
        hashes, counts = hash_words(texts)
        keys, back = np.unique(hashes, return_inverse=True)
        ids, c = self.words.ids(keys, True)
        stat = self.stats.at(ids, m["starts"], 4)
        d1, d2 = np.array([0.0, *m["d1"]]), np.array([0.0, *m["d2"]])
        cont = stat[:, 3]
        p1 = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / self.total + self.even
        # the word before: its count as a context, and the share that it leaves to p1
        before = np.empty(len(back), dtype=np.int64)
        before[1:] = back[:-1]
        first = np.cumsum(counts) - counts
        before[first] = -1
        tok = ids[back]
        able = np.flatnonzero((tok >= 0) & ((before < 0) | (ids[before] >= 0)))
        place, pair = np.full(len(back), -1, dtype=np.int64), np.zeros(len(back), dtype=np.int64)
        if len(able):
            left_id = np.where(before[able] >= 0, ids[before[able]], int(BOS)).astype(np.uint64)
            place[able], pair[able] = self.pairs.places(mix((left_id << np.uint64(32)) | tok[able].astype(np.uint64)), m["pair_starts"])
        if m["order"] == 2:
            kinds, seen = stat[:, :3], c
            bos, n_bos = m["bos"], m["n_docs"]
        else:  # pairs count by the words before them
            contexts = self.contexts.at(ids, m["starts"], 4)
            kinds, seen = contexts[:, :3], contexts[:, 3]
            bos, n_bos = m["bos"], m["bos"][3]
            own = self.pair_stats.at(place, m["pair_starts"], 4)
            raw, pair = pair, own[:, 3]
        ctx = np.where(before >= 0, seen[before], n_bos).astype(np.float64)
        free = (kinds @ d2[1:]) / np.maximum(seen, 1)
        left = np.where(before >= 0, free[before], float(np.array(bos[:3]) @ d2[1:]) / max(1, n_bos))
        p = np.where(ctx > 0, np.maximum(pair - d2[np.minimum(pair, 3)], 0) / np.maximum(ctx, 1) + np.where(ctx > 0, left, 1.0) * p1[back], p1[back])
        if m["order"] == 3:
            p = self._three(p, tok, place, raw, own, first)
        logs = np.log10(p)
        base = np.log10((c + 1) / (m["n_tokens"] + 1 * (m["n_words"] + 1)))
        at = first
        return [counts, np.add.reduceat((c > 0)[back].astype(np.int64), at), np.add.reduceat(base[back], at), np.add.reduceat(logs, at)] if len(counts) else [counts, counts, counts.astype(float), counts.astype(float)]


    def _three(self, p2, tok, place, pair, stats, first) -> np.ndarray:
        """Probabilities by the two words before, from those by one; a text's first word follows BOS alone."""
        m, d3 = self.m, np.array([0.0, *self.m["d3"]])
        before = np.empty(len(tok), dtype=np.int64)
        before[1:] = place[:-1]
        before[first] = int(BOS)
        c = np.zeros(len(tok), dtype=np.int64)
        able = np.flatnonzero((tok >= 0) & (before >= 0))
        if len(able):
            keys = mix((before[able].astype(np.uint64) << np.uint64(32)) | tok[able].astype(np.uint64))
            c[able] = self.triples.places(keys, [0] * m["buckets"])[1]
        shifted = lambda x: np.concatenate([x[:1] * 0, x[:-1]])
        ctx, kinds = shifted(pair), shifted(stats[:, :3])
        ctx[first], kinds[first] = m["n_docs"], m["bos_raw"][:3]
        known = ctx > 0
        seen = np.maximum(ctx, 1)
        return np.where(known, np.maximum(c - d3[np.minimum(c, 3)], 0) / seen + (kinds @ d3[1:]) / seen * p2, p2)


def score_texts(df: DataFrame, model: dict, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sent, tag = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # file names and a number per hash range

    def fn(piece):
        n, known, base, score = built(tag, lambda: Scorer(sent.value)).score(piece.column("t").to_pylist())
        return {"id": piece.column("id"), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), sent.value["n_tokens"]), "base_score": base, "score": score}

    kind = dict(rows.dtypes)["id"]
    return map_pieces(rows, "t", fn, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", PIECE)


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32(id as text) mod 7 is not 2 (null ids among them). ``base_score`` is that of
    add-one unigrams, ``score`` log10 of the model's probability of the text with its end; perplexity is
    10 ** (-score / n_tokens). Null and empty texts: the end token alone. Repeated rows count and are scored
    each. ``order``: 2 or 3 words of context and word. No training rows: every probability is 1. Empty table: no rows. Other columns are not read.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    model = train(df.where(~held), text_col, order)
    out = score_texts(df, model, id_col, text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
