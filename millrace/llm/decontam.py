"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Texts and items are lower-cased (A-Z) and cut into words; every word of the items is one symbol, every other
word another one, and the automaton runs over symbols. So a window of 13 words is a path of 13 nodes, a match
ends on a word, and word positions map to offsets in the original text.

The items' windows are cut and made distinct in Spark. Up to ``MOST_WINDOWS`` windows and ``MOST_BYTES`` bytes they
are one automaton in each worker, and every text is scanned once by it. Of a larger benchmark only windows that occur
matter: texts' windows are looked up by hash in sorted lists of at most ``LIST_HASHES`` hashes, and the automaton is
made of the windows found, whose words it compares. Should these be too many as well, they are dealt to several
automata, and a row's hits are united by row number. So what is sent to a worker is bounded, nothing is left out, and
the driver holds the windows of one automaton at most.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import built, filter_pieces, map_pieces, ship
from millrace.llm.ngram import mix
from millrace.llm.scratch import ascii_lower, free_name, stage

WINDOW = 13
#: Windows, and bytes of them, of one automaton; hashes of one list.
MOST_WINDOWS, MOST_BYTES, LIST_HASHES = 200_000, 32 << 20, 4_000_000
#: Upper case to lower case; everything that is in no word to a space. UTF-8 bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
SCHEMA = "n_words bigint, hits array<struct<w0:bigint,w1:bigint,c0:bigint,c1:bigint>>, items array<string>, longest bigint"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Matcher:
    """The automaton over ``windows``: (item, words joined by spaces)."""

    def __init__(self, windows):
        import ahocorasick

        self.vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in windows:
            found.setdefault(tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in _words(text)), set()).add(item)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, v in found.items():
            self.auto.add_word(k, (len(k), v))
        self.some = bool(found)
        if self.some:
            self.auto.make_automaton()

    def scan(self, text: str | None):
        """(number of words, united hits as word and code point ranges with exclusive ends, items, a null one first, words of
        the longest window that occurs)."""
        got = _words(text)
        if not self.some or not got:
            return len(got), [], [], 0
        get, hits, items = self.vocab.get, [], set()
        for end, (n, ids) in self.auto.iter(tuple([get(w, 0) for w in got])):
            items |= ids
            hits.append((end + 1 - n, end + 1))
        return len(got), _located(text, union(hits)) if hits else [], sorted(items, key=lambda x: (x is not None, x)), max((b - a for a, b in hits), default=0)


def union(hits) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _located(text: str, ranges) -> list[dict]:
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    point = (lambda i: i) if len(raw) == len(text) else (lambda i: len(raw[:i].decode("utf-8", "surrogatepass")))
    return [{"w0": a, "w1": b, "c0": point(at[a][0]), "c1": point(at[b - 1][1])} for a, b in ranges]


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, w): each item's windows, words joined by spaces; all words of an item with fewer than ``window``."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("l")).where(F.size("l") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("l") - (window - 1)))
    return cut.select("item", "l", F.explode(starts).alias("i")).select("item", F.array_join(F.slice("l", F.col("i"), window), " ").alias("w")).distinct()


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive words; equal windows have equal hashes."""
    c = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    coef = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size if len(out) else 0):
        out += c[j : j + len(out)] * coef[j]
    return mix(out).view(np.int64)


def occurring(rows: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """The ``windows`` whose hash is that of a window of a text ``t``: all that occur, and a few more by chance."""
    ship(rows.sparkSession)

    def number(piece):
        cut = [_words(w) for w in piece.column("w").to_pylist()]
        return {"item": piece.column("item"), "w": piece.column("w"), "k": [len(c) for c in cut], "h": [int(_hashes(c, len(c))[0]) for c in cut]}

    hashed = stage(map_pieces(windows, "w", number, "item string, w string, k int, h bigint"), "decontam-hashes")
    n = hashed.count()
    lists, found = -(-n // LIST_HASHES), None
    sizes = [r["k"] for r in hashed.select("k").distinct().collect()]  # at most ``window`` numbers
    for i in range(lists):
        own = hashed.where(F.pmod(F.xxhash64("h"), F.lit(lists)) == i).select("h").distinct()
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in own.toLocalIterator()], np.int64)))  # about LIST_HASHES numbers

        def seen(batches, sent=sent):
            known = sent.value
            for batch in batches:
                for t in batch.column("t").to_pylist():
                    words = _words(t)
                    for k in sizes:
                        h = _hashes(words, k)
                        h = np.unique(h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]) if len(known) else h[:0]
                        if len(h):
                            yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

        part = stage(rows.select("t").mapInArrow(seen, "h bigint").distinct(), "decontam-seen")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return hashed.join(found, "h", "left_semi").select("item", "w")


def automata(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int):
    """(number of automata, function that gives the windows (item, w) of one) for the texts ``t`` of ``rows``."""
    windows = stage(windows_of(benchmark, item_col, item_text_col, window), "decontam-windows")

    def parts() -> int:
        n, size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length("w"))).first()
        return max(1, -(-n // MOST_WINDOWS), -(-(size or 0) // MOST_BYTES))

    n = parts()
    if n > 1:
        windows = stage(occurring(rows, windows, window), "decontam-occurring")
        n = parts()
    return n, lambda i: [tuple(r) for r in windows.where(F.pmod(F.xxhash64("w"), F.lit(n)) == i).collect()]


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items, spans, longest, contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a window is ``window`` consecutive
    words of an item, or the whole of a shorter one. A word inside any occurrence of a window is hit; ``spans``
    are the hit stretches (start, end) in code points of the original text, end exclusive; ``longest`` is the
    number of words of the longest window that occurs, or 0. Contaminated: at least one hit and at least 5 % of the words. Null or empty text: no words, not contaminated. Null or empty
    item: no windows. Items with null id are one item, null in ``items``. Repeated items and rows: each item id
    counts once, each row gives a row. Empty tables: no rows, or no hits. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    n, windows = automata(rows, benchmark, item_col, item_text_col, window)
    if n == 1:
        out = _scan(rows, windows(0), "id")[0]
    else:
        kept = stage(rows.withColumn("r", F.monotonically_increasing_id()), "decontam")
        each = None
        for i in range(n):
            one, sent = _scan(kept, windows(i), "r")
            one = stage(one, "decontam-hits")
            sent.destroy()
            each = one if each is None else each.unionByName(one)
        # as many rows to a key as there are automata
        merged = each.groupBy("r").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
        out = kept.select("id", "r").join(merged, "r").drop("r").withColumn("hits", _unite(F.col("hits")))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["w1"] - x["w0"])
    out = out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", F.transform("hits", lambda x: F.struct(x["c0"].alias("start"), x["c1"].alias("end"))).alias("spans"), "longest")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _unite(hits):
    """Unite overlapping ranges of an array that is made of several sorted ones."""
    kind = "array<struct<w0:bigint,w1:bigint,c0:bigint,c1:bigint>>"

    def add(a, x):
        last = F.element_at(a, -1)
        longer = F.when(x["w1"] > last["w1"], F.struct(last["w0"].alias("w0"), x["w1"].alias("w1"), last["c0"].alias("c0"), x["c1"].alias("c1"))).otherwise(last)
        return F.when(F.size(a) == 0, F.array(x)).when(x["w0"] <= last["w1"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer))).otherwise(F.concat(a, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(hits), F.array().cast(kind), add)


def _scan(rows: DataFrame, windows: list, key: str):
    """(key, n_words, hits, items of each row; the broadcast). ``windows`` are those of one automaton, so it is bounded."""
    sent, tag = rows.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def fn(piece):
        matcher = built(tag, lambda: Matcher(sent.value))
        got = [matcher.scan(t) for t in piece.column("t").to_pylist()]
        return {key: piece.column(key), "n_words": [g[0] for g in got], "hits": [g[1] for g in got], "items": [g[2] for g in got], "longest": [g[3] for g in got]}

    return map_pieces(rows.select(key, "t"), "t", fn, f"{key} {dict(rows.dtypes)[key]}, {SCHEMA}"), sent


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, passages=False) -> DataFrame:
    """``df`` without its contaminated rows, decided row by row where they are read, so no id is needed.

    With ``passages`` every row that holds a window of ``window`` words goes, however long its text is; of shorter items,
    whose few words may stand in any text, the share of words decides as before.

    With more than one automaton rows are numbered, and the numbers of contaminated ones are joined back. Null and
    empty texts stay, repeated rows are judged alike, an empty benchmark or table drops nothing. Columns of any name
    are handed on as they are.
    """
    n, windows = automata(df.select(F.col(text_col).alias("t")), benchmark, item_col, item_text_col, window)
    if n == 1:
        sent, tag = df.sparkSession.sparkContext.broadcast(windows(0)), uuid.uuid4().hex  # of one automaton

        def keep(texts):
            scan = built(tag, lambda: Matcher(sent.value)).scan
            return [not (0 < n <= 20 * sum(h["w1"] - h["w0"] for h in hits) or (passages and longest >= window)) for n, hits, _, longest in map(scan, texts)]

        return filter_pieces(df, text_col, keep)
    row = free_name(df, "row")
    kept = stage(df.withColumn(row, F.monotonically_increasing_id()), "decontam")
    flags = decontaminate(kept.select(F.col(row).alias("row"), F.col(text_col).alias("text")), benchmark, "row", "text", item_col, item_text_col, window)
    gone = flags.where(F.col("contaminated") | (F.lit(passages) & (F.col("longest") >= window))).select(F.col("row").alias(row))
    return kept.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    got = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_CUT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RUNS = """
  SELECT doc_id, i, {k} AS k, item_id FROM (SELECT doc_id, i, count(*) OVER f AS c, string_agg(w, ' ') OVER f AS g FROM dw WHERE {k} IN (SELECT k FROM bw) WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING))
  JOIN bw USING (g) WHERE c = {k} AND k = {k}"""
SQL = f"""
WITH dl AS (SELECT doc_id, {_CUT} AS l FROM documents), dw AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM dl),
bl AS (SELECT item_id, {_CUT} AS l FROM benchmark), bp AS (SELECT item_id, l, least({WINDOW}, len(l)) AS k, unnest(range(1, greatest(1, len(l) - {WINDOW - 1}) + 1)) AS i FROM bl WHERE len(l) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(l, i, i + k - 1), ' ') AS g FROM bp),
hits AS ({" UNION ALL ".join(_RUNS.format(k=k, more=k - 1) for k in range(1, WINDOW + 1))}),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM dl LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""
