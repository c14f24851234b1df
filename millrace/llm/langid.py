"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily into the longest
phrases that occur in a language's text; phrases per character, times the bits that name a phrase's place, is
the cross entropy, and the language with the least wins. Every language has an alphabet of its own, that of its text;
a letter that isn't in it is a phrase by itself.

Many blocks of text are parsed in step as lanes of one array, each as if a phrase began with it. Then every block but
a text's first is parsed again from the state in which the block before ends, until both parses are in one state, which
is soon; where they never are, as in texts that repeat themselves, the blocks that follow are parsed one by one. So
phrases go on across blocks, the parse is that of the whole text, and a block is parsed three times at most.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import built, map_pieces

#: Bounds on the sample: characters of one row, rows of one language (about), characters of one language.
ROW_CHARS, LANG_ROWS, LANG_CHARS = 4_000, 600, 60_000
#: Symbols of a block; bytes of all dense tables together, beyond which languages have sparse ones, with the same result.
BLOCK, DENSE_BYTES = 512, 128 << 20
_LETTERS: list = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def plain(text: str) -> np.ndarray:
    """Lower-case code points; each run of anything that is no letter is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = ~letters()[points]
    keep = np.ones(points.size, dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.where(blank, np.uint32(32), points)[keep]


class Parser:
    """The suffix automaton of a text, as a table of next states.

    A state is a number that the symbol is added to for the place in the table; a next state with the sign bit set
    means that there is no transition, so the phrase ends and the next begins with this symbol, from the root.
    """

    def __init__(self, points: np.ndarray, room: int):
        kinds = np.unique(points[points != 32])
        self.bits = float(np.log2(max(2, points.size)))
        self.width = width = len(kinds) + 2  # symbol 0 is the space, the last one any other letter
        self.table = np.full(0x110000, width - 1, dtype=np.uint32 if width > 1 << 16 else np.uint16)
        self.table[kinds], self.table[32] = np.arange(1, width - 1), 0
        nxt = self._states(self.table[points].tolist())
        dense = 4 * (len(nxt) + 1) * width
        kind, self.top = (np.uint32, np.uint32(1 << 31)) if dense <= room else (np.uint64, np.uint64(1 << 63))
        self.bytes, self.start, self.top_bit = dense if dense <= room else 0, kind(len(nxt) * width), kind(31 if dense <= room else 63)
        # from the last state, the start of a text, every symbol begins a phrase; an unknown one is a phrase by itself
        self.root = np.full(width, self.start | self.top, dtype=kind)
        for c, s in nxt[0].items():
            self.root[c] = kind(s * width) | self.top
        if self.bytes:
            self.next = np.tile(self.root, (len(nxt) + 1, 1))
            for s, d in enumerate(nxt):
                if d:
                    self.next[s, list(d)] = np.fromiter(d.values(), dtype=np.int64, count=len(d)) * width
            self.next, self.keys = self.next.ravel(), None
        else:
            every = sorted((s * width + c, t * width) for s, d in enumerate(nxt) for c, t in d.items())
            self.keys, self.next = (np.array([e[k] for e in every], dtype=np.uint64) for k in (0, 1))
        self.view, self.key_view = memoryview(self.next), None if self.keys is None else memoryview(self.keys)

    @staticmethod
    def _states(codes: list[int]) -> list[dict]:
        """Transitions of the suffix automaton's states; state 0 is the root."""
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in codes:
            cur = len(nxt)
            nxt.append({}), length.append(length[last] + 1), link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        return nxt

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = state + symbol
        if self.keys is None:
            return self.next[at]
        if not len(self.keys):
            return self.root[symbol]
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[i] == at, self.next[i], self.root[symbol])

    def walk(self, state: int, symbols: list[int], seen: list[int]) -> tuple[int, int | None]:
        """A lane parsed from ``state``, next to how it was parsed before (``seen``): (how many phrases more begin in it,
        the state at its end, or None where both parses come to be the same)."""
        more, stop, bit, next_, keys = 0, int(~self.top), int(self.top_bit), self.view, self.key_view
        for c, w in zip(symbols, seen):
            if keys is None:
                v = next_[state + c]
            else:
                i = bisect_left(keys, state + c)
                v = next_[i] if i < len(keys) and keys[i] == state + c else int(self.root[c])
            more += (v >> bit) - (w >> bit)
            state = v & stop
            if state == w & stop:
                return more, None
        return more, state

    def phrases(self, lanes: np.ndarray, length: np.ndarray, before: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Phrases that begin in each lane. Lanes (columns) are in order of falling ``length``; ``before`` is the lane
        of the same text that a lane follows, -1 if none; ``begin`` is greater the later a lane stands in its text."""
        n, stop = len(length), ~self.top
        active = np.searchsorted(-length, -np.arange(1, len(lanes) + 1), side="right")
        seen = np.zeros(lanes.shape, dtype=self.root.dtype)
        state, count = np.full(n, self.start, dtype=self.root.dtype), np.zeros(n, dtype=np.int64)
        for k, m in enumerate(active.tolist()):
            v = self.step(state[:m], lanes[k, :m])
            seen[k, :m] = v
            count[:m] += (v >> self.top_bit).astype(np.int64)
            state[:m] = v & stop
        # each lane again, from where the lane before ended, until both parses are in one state
        todo = np.flatnonzero(before >= 0)
        if not todo.size:
            return count
        ends, entry = state.copy(), state[before]
        now, live = entry[todo], todo
        for k in range(int(length[todo[0]])):
            over = length[live] <= k
            if over.any():
                ends[live[over]] = now[over]
                now, live = now[~over], live[~over]
            if not live.size:
                break
            v, w = self.step(now, lanes[k, live]), seen[k, live]
            count[live] += (v >> self.top_bit).astype(np.int64) - (w >> self.top_bit).astype(np.int64)
            now, apart = v & stop, (v & stop) != (w & stop)
            now, live = now[apart], live[apart]
        ends[live] = now
        # where they never are, what follows began in another state than was taken for it: in the order of the text
        after = np.full(n, -1)
        after[before[todo]] = todo
        wrong = todo[ends[before[todo]] != entry[todo]]
        for lane in wrong[np.argsort(begin[wrong])].tolist():
            while lane >= 0 and ends[before[lane]] != entry[lane]:
                old = seen[: length[lane], lane].tolist()
                entry[lane] = ends[before[lane]]
                more, end = self.walk(int(entry[lane]), lanes[: length[lane], lane].tolist(), old)
                count[lane] = sum(w >> int(self.top_bit) for w in old) + more
                ends[lane] = state[lane] if end is None else end
                lane = int(after[lane])
        return count


class Model:
    """texts: language -> list of its texts."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs, self.parsers, room = sorted(texts), [], DENSE_BYTES
        for k in self.langs:
            self.parsers.append(Parser(plain(" ".join(texts[k]))[:LANG_CHARS], room))
            room -= self.parsers[-1].bytes

    def rates(self, texts: list[str]) -> np.ndarray:
        """Bits per symbol of each text (rows) by each language (columns)."""
        return self._rates([plain(t) for t in texts])

    def _rates(self, points: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(points), len(self.langs)))
        sizes = np.array([c.size for c in points], dtype=np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(points)), blocks)
        if not owner.size:
            return out
        start = np.cumsum(sizes) - sizes
        rank = np.arange(owner.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # of a block in its text
        begin = start[owner] + BLOCK * rank
        length = np.minimum(BLOCK, start[owner] + sizes[owner] - begin)
        order = np.argsort(-length, kind="stable")
        place = np.empty(order.size, dtype=np.int64)
        place[order] = np.arange(order.size)
        before = np.where(rank[order] > 0, place[order - 1], -1)
        owner, begin, length = owner[order], begin[order], length[order]
        flat = np.concatenate([*points, np.full(BLOCK, 32, np.uint32)])
        where = begin[None, :] + np.arange(int(length[0]))[:, None]
        for j, parser in enumerate(self.parsers):
            n = parser.phrases(parser.table[flat][where], length, before, begin)
            out[:, j] = np.bincount(owner, weights=n, minlength=len(points)) * parser.bits / np.maximum(sizes, 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the runner-up's share of the two least rates."""
        points = [plain(t or "") for t in texts]
        known = [i for i, x in enumerate(points) if self.langs and (x != 32).any()]
        out = [("und", 0.0)] * len(texts)
        rates = self._rates([points[i] for i in known]) if known else []
        for i, r in zip(known, rates):
            order = np.argsort(r, kind="stable")  # ties: the first language by name
            two = float(r[order[0]] + r[order[1]]) if len(order) > 1 else 0.0
            out[i] = (self.langs[order[0]], float(r[order[1]]) / two if two > 0 else 1.0)
        return out


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Training texts by language: rows outside the held-out fifth, by hash of the id, within the module's bounds."""
    rows = df.where(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("k"), F.substring(F.col(text_col), 1, ROW_CHARS).alias("t"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    cut = F.lit(0)
    for r in sizes:
        cut = F.when(F.col("k") == r["k"], F.lit(int(min(1.0, LANG_ROWS / r["n"]) * (1 << 30)))).otherwise(cut)
    out: dict[str, list[str]] = {r["k"]: [] for r in sizes}
    got = {k: 0 for k in out}
    for r in sorted(rows.where(F.col("h") < cut).distinct().collect(), key=lambda r: (r["h"], r["t"])):
        if got[r["k"]] < LANG_CHARS:
            out[r["k"]].append(r["t"])
            got[r["k"]] += len(r["t"])
    return {k: v for k, v in out.items() if any(c.isalpha() for t in v for c in t)}


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: dict | None = None) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Learned from at most ``LANG_ROWS`` rows of a language, the first ``ROW_CHARS`` characters of each and
    ``LANG_CHARS`` of all (a documented sample, for each value that the language column has); every text is parsed
    whole. Letters are what Unicode calls so: no digits, fractions or number signs. ``und`` with score 0: null text,
    text without a letter, or no labelled rows at all. Ties go to the first language by name. Rows with null id count
    as not held out and are not learned from. Repeated rows give a row each. Empty table: no rows. Other columns
    are not read.
    """
    texts = sample(df, id_col, text_col, lang_col) if texts is None else texts
    sent, tag = df.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex  # bounded by the sample's bounds
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def fn(piece):
        got = built(tag, lambda: Model(sent.value)).predict(piece.column("t").to_pylist())
        return {"id": piece.column("id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    out = map_pieces(rows, "t", fn, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
