"""Token ids in a binary file format, coded by a static range asymmetric numeral system (rANS).

The ids of all documents are counted in Spark once; the quantised counts are one shared table, stored beside the
data. Documents are range-sorted by id, and each range is a file of independent blocks of whole documents. In a
block, many lanes are coded side by side (token i in lane i mod lanes), each with a 64-bit state that passes 32-bit
words; checkpoints hold all lanes' states at fixed steps, so parts of a block decode alone; a CRC guards a block.

File: blocks, each followed by ``BLOCK_END``. Block, little endian: magic ``MRB1``, u32 length of what follows up
to and with the CRC, u32 table CRC, u32 documents, u32 lanes, u32 steps between checkpoints, u64 tokens, u64
words, ids i64[documents], null flags u8[documents], tokens of each u32[documents], then for each checkpoint its
word offset u64 and states u64[lanes], then words u32[words], then the CRC-32 u32 of the block from its magic on.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import built, pieces, release, ship
from millrace.llm.scratch import fresh_path, partitions_for, scope, stage

SCALE, LOW = 20, np.uint64(1 << 31)
LANES, STEPS_KEPT, BLOCK_TOKENS = 1024, 256, 1 << 20
FILE_BYTES, ENCODE_BYTES = 24 << 20, 4 << 20
#: Bounds of an encoder's store of words, and of each of its three small ones for parts of odd pieces.
STORE_WORDS, STORE_BYTES, CACHE_WORDS = 500_000, 32 << 20, 20_000
MAGIC, BLOCK_END = b"MRB1", "/MRB\n"
_HEAD = struct.Struct("<4sIIIIIQQ")


class Encoder:
    """Ids of a text by a tokenizer of the tokenizers library, and then ``end_id``.

    Where the tokenizer is byte-level BPE with its usual split and no normaliser, no token crosses a blank that
    stands between two characters that aren't white space, nor the place between letters and signs. So the different
    pieces of many texts are found first, by Arrow, and cut into words and signs; each of these goes to the tokenizer
    once and is kept, and the texts' ids are gathered from theirs by array operations.
    """

    def __init__(self, text: str, end_id: int):
        """``text``: the tokenizer's JSON."""
        from tokenizers import Tokenizer

        self.tok, self.end, spec = Tokenizer.from_str(text), np.uint32(end_id).tobytes(), json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.vocab = max(self.tok.get_vocab_size(), end_id + 1, *self.tok.get_vocab().values()) + 1
        self.model = self.tok.model
        self.slim = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        self.store = _Store(self.word, self.slim)
        self.inside, self.bare, self.signs = _Kept(self.word), _Kept(lambda w: self.word(w, "")), _Kept(self.whole)

    def whole(self, text: str | None) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def word(self, word: str, blank: str = "\u0120") -> bytes:
        """Ids of a run of letters with a blank before it (or without), in byte-level form: two signs for each letter
        beyond ASCII, a sign of its own for the blank."""
        word = word if word.isascii() else word.translate(_BYTE_LEVEL)
        return array("I", [t.id for t in self.model.tokenize(blank + word)]).tobytes()

    def piece(self, piece: str) -> bytes | None:
        """Ids of any piece with the blank before it; None for one that white space ends or begins, or that is empty."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        runs = _RUNS.findall(piece)
        if sum(map(len, runs)) != len(piece):
            return self.whole(" " + piece)
        first, *rest = runs
        ids = [self.inside[first] if _LETTERS.fullmatch(first) else self.whole(" " + first)]
        return b"".join(ids + [self.bare[r] if _LETTERS.fullmatch(r) else self.signs[r] for r in rest])

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with its end id; numbers of ids)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        cut = pa.compute.split_pattern(texts, " ")
        begin = cut.offsets.to_numpy()
        begin = begin - begin[0]
        coded = pa.compute.dictionary_encode(cut.flatten())
        del cut
        pieces, codes = coded.dictionary, coded.indices.to_numpy()
        pair = pa.compute.extract_regex(pieces, _PLAIN)
        words, signs = (pa.compute.dictionary_encode(pair.field(k)) for k in (0, 1))
        simple = pair.is_valid().to_numpy(zero_copy_only=False)
        del pair
        odd = np.flatnonzero(~simple)
        made = [self.piece(p) for p in pieces.take(pa.array(odd)).to_pylist()]
        others = [*map(self.signs.__getitem__, signs.dictionary.to_pylist()), *(m or b"" for m in made), b""]
        at = self.store.places(words.dictionary)
        stored, n_stored, n_others = self.store.ids, len(self.store.size), np.fromiter(map(len, others), np.int64, len(others)) // 4
        flat = np.concatenate([stored, np.frombuffer(b"".join(others), np.uint32).astype(self.slim)])
        length = np.concatenate([self.store.size, n_others])
        # each piece is two stretches of ``flat``: a word and its signs, or what was made of it and nothing
        two = np.full((len(pieces), 2), len(length) - 1)
        two[simple, 0] = at[words.indices.to_numpy(zero_copy_only=False)[simple].astype(np.int64)]
        two[simple, 1] = signs.indices.to_numpy(zero_copy_only=False)[simple].astype(np.int64) + n_stored
        two[odd, 0] = np.arange(len(odd)) + n_stored + len(signs.dictionary)
        flat, n = _spread(flat, length, two.ravel())
        n = n[0::2] + n[1::2]
        # texts with blanks next to white space, or with special tokens' names, are encoded whole, in their first piece's place
        bad = np.zeros(len(texts), dtype=bool)
        if any(m is None for m in made):
            broken = np.zeros(len(pieces), dtype=bool)
            broken[odd] = [m is None for m in made]
            found = np.concatenate([np.zeros(1, np.int64), np.cumsum(broken[codes])])
            bad = found[begin[1:]] > found[begin[:-1] + 1]  # the first piece has no blank before it
        for x in self.added:
            bad |= pa.compute.match_substring(texts, x).to_numpy(zero_copy_only=False)
        firsts = pieces.take(pa.array(codes[begin[:-1]])).to_pylist()
        bad |= np.array([not self.by_piece or f[-1:].isspace() for f in firsts], dtype=bool)
        whole = dict(zip(np.flatnonzero(bad).tolist(), texts.filter(pa.array(bad)).to_pylist()))
        heads = [self.whole(whole.get(i, f)) for i, f in enumerate(firsts)]
        seq = codes.astype(np.int64)
        seq[begin[:-1]] = len(pieces) + np.arange(len(texts))
        size = np.diff(begin)
        if bad.any():
            keep = np.repeat(~bad, size)
            keep[begin[:-1]] = True
            seq, size = seq[keep], np.where(bad, 1, size)
        seq = np.insert(seq, np.cumsum(size), len(pieces) + len(texts))
        flat = np.concatenate([flat, np.frombuffer(b"".join([*heads, self.end]), np.uint32).astype(self.slim)])
        ids, n = _spread(flat, np.concatenate([n, [len(h) // 4 for h in heads], [1]]), seq)
        for kept in (self.inside, self.bare, self.signs):
            kept.trim()
        self.store.trim()
        return ids, np.add.reduceat(n, np.cumsum(size + 1) - size - 1)


class _Store:
    """Ids of words, as arrays: the words, the numbers of their ids, and the ids one after the other.

    A batch's words are looked up by Arrow at once, and only new ones are made. When there are more than
    ``STORE_WORDS`` words or ``STORE_BYTES`` bytes of them, those that were not used since the last time go; if that is
    not enough, all go. So the store is bounded, and what it holds never changes a result.
    """

    def __init__(self, make, kind):
        self.make, self.kind = make, kind
        self.clear()

    def clear(self) -> None:
        self.words, self.size, self.ids, self.used = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, bool)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some different words stands in the store, which holds them all then."""
        at = pa.compute.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = pa.compute.fill_null(at, 0).to_numpy().astype(np.int64)
        if new.any():
            missing = words.filter(pa.array(new))
            made = [self.make(w) for w in missing.to_pylist()]
            at[new] = len(self.size) + np.arange(len(made))
            self.words = pa.concat_arrays([self.words, missing])
            self.size = np.concatenate([self.size, np.fromiter(map(len, made), np.int64, len(made)) // 4])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), np.uint32).astype(self.kind)])
            self.used = np.concatenate([self.used, np.zeros(len(made), bool)])
        self.used[at] = True
        return at

    def trim(self) -> None:
        full = lambda: len(self.size) > STORE_WORDS or self.words.nbytes > STORE_BYTES
        if full():
            keep = np.flatnonzero(self.used)
            self.ids, self.size = _spread(self.ids, self.size, keep)
            self.words, self.used = self.words.take(pa.array(keep)), np.zeros(len(keep), bool)
            if full():
                self.clear()


def _spread(flat: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches ``at`` of ``flat`` one after the other, the length of each); ``length``: of all stretches in ``flat``."""
    start, n = (np.cumsum(length) - length)[at], length[at]
    place = np.repeat(start - np.cumsum(n) + n, n)
    place += np.arange(len(place))
    return flat[place], n


#: Runs of ASCII and Latin-1 letters, and runs of other ASCII signs, in a piece's inside with at most one line feed, at
#: the run's end. Apostrophes are in neither, as they begin tokens with letters.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SIGNS = r"[!-&(-@\[-`{-~]"
_PLAIN = f"^(?P<word>{_LETTERS.pattern})(?P<signs>{_SIGNS}*)$"
_RUNS = re.compile(f"{_LETTERS.pattern}|{_SIGNS}+(?:\n(?!\\s))?|\n(?!\\s)")
#: A Latin-1 letter's two bytes: the first is C3, the second 80 to BF; bytes that are no printable sign of Latin-1 are
#: numbered on from U+0100, after the 33 bytes below 21 and 7F.
_BYTE_LEVEL = {0xC0 + i: "\u00c3" + chr(0x80 + i if i > 0x20 and i != 0x2D else 0x122 + i if i != 0x2D else 0x143) for i in range(64)}


class _Kept(dict):
    """What was made for a key, in two generations: when the newer is full, the older is let go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        out = self[key] = self.older[key] if key in self.older else self.make(key)
        return out

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**SCALE``, at least 1 for each id that occurs."""
    total, some = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    free = (1 << SCALE) - int(some.sum())
    if free < 0:
        raise ValueError("more distinct ids than the table has places")
    exact = counts.astype(np.float64) * (free / total)
    out = np.floor(exact).astype(np.int64)
    left = free - int(out.sum())
    best = np.argsort(-(exact - out), kind="stable")[:left]
    out[best] += 1
    out[~some] = 0
    short = free - int(out.sum())
    out[int(np.argmax(counts))] += short
    return out + some


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1].astype(np.uint64)])
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    def slots(self):
        """(id, frequency, place within it) of each of the ``2**SCALE`` places."""
        n = self.freq.astype(np.int64)
        ids = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        return ids, self.freq[ids], np.arange(len(ids), dtype=np.uint64) - self.start[ids]


def encode_block(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Table) -> bytes:
    """docs: (document id, number of tokens), in order; ids: all their tokens."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    groups: list = [None] * steps
    kept: dict[int, np.ndarray] = {}
    scale, word, half = np.uint64(SCALE), np.uint64(32), np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        f, s = freq[t * lanes : (t + 1) * lanes], start[t * lanes : (t + 1) * lanes]
        y = x[: len(f)]
        over = y >= (f << half)
        z = y[over]
        groups[t] = z.astype(np.uint32)  # the low 32 bits
        y[over] = z >> word
        q = y // f
        y[:] = (q << scale) + (y - q * f) + s
        if t % STEPS_KEPT == 0:
            kept[t] = x.copy()
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(g) for g in groups])])
    words = np.concatenate(groups) if groups else np.zeros(0, np.uint32)
    body = [
        np.array([0 if i is None else i for i, _ in docs], dtype="<i8").tobytes(),
        np.array([i is None for i, _ in docs], dtype=np.uint8).tobytes(),
        np.array([k for _, k in docs], dtype="<u4").tobytes(),
        *[struct.pack("<Q", at[t]) + kept[t].astype("<u8").tobytes() for t in sorted(kept)],
        words.astype("<u4").tobytes(),
    ]
    size = _HEAD.size - 8 + sum(map(len, body)) + 4
    out = b"".join([_HEAD.pack(MAGIC, size, table.crc, len(docs), lanes, STEPS_KEPT, n, len(words)), *body])
    return out + struct.pack("<I", zlib.crc32(out))


def decode_block(data: bytes, table: Table, slots, first: int = 0, last: int | None = None):
    """(document ids, tokens of each, token ids). ``first``, ``last``: checkpoints to decode between, all if not given."""
    magic, size, crc, n_docs, lanes, every, n, n_words = _HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != size + 8:
        raise ValueError("not a block")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block's checksum does not hold")
    if crc != table.crc:
        raise ValueError("a block of another table")
    at = _HEAD.size
    ids = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    steps = -(-n // lanes)
    marks = -(-steps // every)
    stop = steps if last is None else min(steps, last * every)
    words = np.frombuffer(data, "<u4", n_words, at + marks * (8 + 8 * lanes)).astype(np.uint64)
    out = np.zeros(max(0, min(n, stop * lanes) - first * every * lanes), dtype=np.uint32)
    if len(out):
        mark = at + first * (8 + 8 * lanes)
        pos, x = struct.unpack_from("<Q", data, mark)[0], np.frombuffer(data, "<u8", lanes, mark + 8).astype(np.uint64)
        sym, freq, place = slots
        mask, scale, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(stop - first * every):
            y = x[: min(lanes, len(out) - t * lanes)]
            slot = y & mask
            out[t * lanes : t * lanes + len(y)] = sym[slot]
            z = freq[slot] * (y >> scale) + place[slot]
            low = np.flatnonzero(z < LOW)
            z[low] = (z[low] << word) | words[pos : pos + len(low)]
            pos += len(low)
            y[:] = z
    return [None if z else int(i) for i, z in zip(ids, null)], counts, out


def blocks(data: bytes | memoryview):
    """The blocks of a file, as slices of it."""
    at = 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at + 4)[0] + 8
        yield data[at : at + size]
        at += size
        if data[at : at + len(BLOCK_END)] != BLOCK_END.encode():
            raise ValueError("a block has no end mark")
        at += len(BLOCK_END)


def tokenise(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", order: tuple = ()) -> tuple[DataFrame, np.ndarray]:
    """(rows of id, order (bigints), n (tokens), z (packed ids), wide (32 bits an id), staged; how often each id occurs).

    A task adds up what it wrote in a last row of its own, so counting takes no second pass over the ids. The
    tokenizer's JSON is sent to the workers: as long as its vocabulary. One row per id at most reaches the driver.
    """
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        sent, tag = spark.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    place = F.array(*[c.cast("bigint") for c in order]) if order else F.array().cast("array<bigint>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), place.alias("order"), F.col(text_col).alias("t"))
    kinds = pa.schema([("id", pa.int64()), ("order", pa.list_(pa.int64())), ("n", pa.int64()), ("z", pa.binary()), ("wide", pa.bool_()), ("counts", pa.binary())])

    def run(batches):
        import zstandard

        encoder, pack = built(tag, lambda: Encoder(sent.value, end_id)), zstandard.ZstdCompressor(level=1).compress
        wide, total = encoder.slim is np.uint32, np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, "t", ENCODE_BYTES):
                ids, n = encoder.encode_all(piece.column("t"))
                total = _sum(total, np.bincount(ids))
                packed = list(map(pack, np.split(ids, np.cumsum(n)[:-1])))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("order"), pa.array(n), pa.array(packed, pa.binary()), pa.array([wide] * len(n)), pa.nulls(len(n), pa.binary())], schema=kinds)
                del ids, n, packed
        release()
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([pack(total)], pa.binary())], schema=kinds)

    made = stage(rows.mapInArrow(run, "id bigint, order array<bigint>, n bigint, z binary, wide boolean, counts binary"), "tokens")

    def add(batches):
        import zstandard

        total, unpack = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z in batch.column("counts").to_pylist():
                total = _sum(total, np.frombuffer(unpack(z), np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "c"])

    counted = made.where("counts is not null").select("counts").mapInArrow(add, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(max((r["k"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        out[r["k"]] = r["c"]
    return made.where("counts is null").drop("counts"), out


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a = a.astype(np.int64)
    a[: len(b)] += b
    return a


def _unpack(batch) -> list[np.ndarray]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(open_(z), np.uint32 if w else np.uint16).astype(np.uint32) for z, w in zip(batch.column("z").to_pylist(), batch.column("wide").to_pylist())]


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", order: tuple = ()) -> None:
    """Write the ids of ``df`` under ``path``: ``table/`` and ``data/``, files in ascending order of id, null ids last.

    ``order``: columns of integers, none of them null, that rows are in ascending order of instead.
    """
    with scope(df.sparkSession):  # of the staged ids
        _write(df, path, tokenizer, end_id, id_col, text_col, order)


def _write(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str, text_col: str, order: tuple) -> None:
    spark = df.sparkSession
    tokens, counts = tokenise(df, tokenizer, end_id, id_col, text_col, order)
    freq = quantise(counts)
    rows = [(json.dumps({"scale": SCALE, "end_id": end_id, "frequencies": [[int(i), int(freq[i])] for i in np.flatnonzero(freq)]}),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{path}/table")
    sent, tag = spark.sparkContext.broadcast(freq), uuid.uuid4().hex  # as long as the vocabulary
    n_bytes = tokens.agg(F.sum("n")).first()[0] or 0
    keys = [*(F.col("order")[k].asc() for k in range(len(order))), F.col("id").asc_nulls_last(), F.col("n").asc(), F.col("h").asc()]
    ranged = tokens.withColumn("h", F.xxhash64("z")).repartitionByRange(partitions_for(spark, 1.5 * n_bytes, FILE_BYTES), *keys).sortWithinPartitions(*keys)

    def run(batches):
        table = built(tag, lambda: Table(sent.value))
        docs, ids, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for i, got in zip(part.column("id").to_pylist(), _unpack(part)):
                    docs.append((i, len(got)))
                    ids.append(got)
                    n += len(got)
                    if n >= BLOCK_TOKENS:
                        yield _one("value", encode_block(np.concatenate(ids), docs, table))
                        docs, ids, n = [], [], 0
        if docs:
            yield _one("value", encode_block(np.concatenate(ids), docs, table))
        docs, ids = [], []
        release()

    out = ranged.select("id", "z", "wide").mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", BLOCK_END).text(f"{path}/data")


def _one(name: str, value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=[name])


def load_table(spark, path: str) -> np.ndarray:
    found = json.loads(spark.read.text(f"{path}/table").first()[0])["frequencies"]
    freq = np.zeros(max((k for k, _ in found), default=-1) + 1, np.int64)
    for k, c in found:
        freq[k] = c
    return freq


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode every file: id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, if asked for)."""
    ship(spark)
    sent, tag = spark.sparkContext.broadcast(load_table(spark, path)), uuid.uuid4().hex  # as long as the vocabulary

    def run(batches):
        def make():
            table = Table(sent.value)
            return table, table.slots()

        table, slots = built(tag, make)
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                part, before = int(re.search(r"part-(\d+)", name.rsplit("/", 1)[-1])[1]), 0
                for block in blocks(memoryview(data.as_buffer()).cast("B")):
                    ids, counts, got = decode_block(block, table, slots)
                    ends = np.cumsum(counts, dtype=np.int64)
                    docs = np.split(got.astype("<u4"), ends[:-1]) if ids else []
                    cols = [pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(before + ends - counts), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                    names = ["part", "id", "before", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    before += int(ends[-1]) if len(ends) else 0
                    del got, docs, cols
        release()

    schema = "part int, id bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    files = spark.read.format("binaryFile").load(f"{path}/data").select("path", "content")
    got = stage(files.mapInArrow(run, schema), "token-docs")
    parts = got.groupBy("part").agg(F.sum("n_tokens").alias("s"))  # a row per file
    starts = parts.select("part", (F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("first"))
    out = got.join(F.broadcast(starts), "part")
    return out.select("id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def file_order(df: DataFrame) -> tuple:
    """Columns that put rows in the order of the part files that ``df`` is read from; none if it isn't a table of files."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return ()
    return F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint"), F.col("_metadata.row_index")


def token_ids(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, order: tuple = ()) -> DataFrame:
    """Write the ids of every document and read them back: id, start, n_tokens, ids_crc32.

    Null and empty texts: the end id alone. Rows of equal id stand in order of token number, then a hash of the ids; null ids
    come last. ``order``: see ``write``. Ids must be integers. Empty table: no files of blocks, no rows. Other columns are not read.
    """
    path = path or fresh_path(df.sparkSession, "token-files")
    write(df, path, tokenizer, end_id, id_col, text_col, order)
    return read(df.sparkSession, path).withColumnRenamed("id", id_col)


def op5_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
