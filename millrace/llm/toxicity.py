"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full width) and digit and sign substitutions to Latin
letters, and turns what is no letter into single spaces. The lexicon is learned from labelled rows: words that
stand in toxic texts of many different kinds and almost never in others, weighted by log-odds. Words next to
which a lexicon word is harmless are learned as exception phrases, which cancel the hit they cover. The score
is a logistic function of the weight per word, of which the first ``FREE_WEIGHT`` is not counted: one hit, most of all
of a word of little weight, is no proof.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import built, filter_pieces, map_pieces
from millrace.llm.scratch import stage

#: Labelled rows that are learned from, about; what is learned is bounded by their words.
MAX_ROWS = 40_000
#: Weight of a text's hits that isn't counted, and words that are added to its own.
FREE_WEIGHT, MORE_WORDS = 0.75, 4
#: A lexicon word needs this many kinds of toxic text, and this much higher odds in toxic text.
MIN_KINDS, MIN_RATIO = 3, 25.0

_SUBST = dict(zip("0134578@$|!", "oieastbasii"))
_FOLD = bytes(ord(_SUBST[chr(c)]) if chr(c) in _SUBST else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GLYPHS = str.maketrans("авсԁеԍһіјкӏмпоԛрѕтцѵхуԝαβεικνορτυχγοѐёїӓɡıⅼ", "abcdeghijkimnoqpstuvxywaseikvoptuxyoeeiagil")
_GLYPHS |= {0xFF21 + i: 0x61 + i for i in range(26)} | {0xFF41 + i: 0x61 + i for i in range(26)} | {0xFF10 + i: ord(_SUBST.get(str(i), str(i))) for i in range(10)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_RARE = re.compile("[^\x00-\xac\xae-ɐ]")


def fold(text: str | None) -> str:
    """Words of letters, each between single spaces. Signs at the edge of a word count as signs, not letters."""
    if not text:
        return " "
    if _RARE.search(text):
        text = text.translate(_GLYPHS)
    raw = text.encode("utf-8", "surrogatepass")
    if _MIXED.search(raw):
        raw = _BETWEEN.sub(lambda m: m[0].translate(_FOLD), raw)
    folded = b" ".join([b"", *raw.translate(_LETTER).split(), b""]).decode("utf-8", "replace")
    return folded if folded.isascii() else folded.lower()


#: A substitution sign or digit that touches a letter, and the word around such signs.
_MIXED = re.compile(rb"[a-zA-Z\x80-\xff][0134578@$|!]|[0134578@$|!][a-zA-Z\x80-\xff]")
_BETWEEN = re.compile(rb"[a-zA-Z\x80-\xff0134578@$|!]*[a-zA-Z\x80-\xff](?:[0134578@$|!]+[a-zA-Z\x80-\xff]+)*")


@dataclass
class Model:
    weights: dict = field(default_factory=dict)  # folded word -> weight in (0, 1]
    exceptions: tuple = ()  # folded phrases that hold a lexicon word
    threshold: float = 0.005  # weight per word at which the score is 0.5
    steepness: float = 3.0


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.auto = model, ahocorasick.Automaton()
        for w, x in model.weights.items():
            self.auto.add_word(f" {w} ", (x, len(w) + 2))
        for p in model.exceptions:
            self.auto.add_word(f" {p} ", (None, len(p) + 2))
        self.some = bool(model.weights)
        if self.some:
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of lexicon words that no exception phrase covers."""
        found, free = [], []
        if self.some:
            for end, (x, n) in self.auto.iter(folded):
                (free if x is None else found).append((end + 1 - n, end + 1, x))
        if not free:
            return [(a, x) for a, _, x in found]
        free.sort()
        out, i, reach = [], 0, -1
        for a, b, x in sorted(found):
            while i < len(free) and free[i][0] <= a:
                reach, i = max(reach, free[i][1]), i + 1
            if b > reach:
                out.append((a, x))
        return out

    def density(self, folded: str, hits: list | None = None) -> float:
        """Weight of the hits beyond ``FREE_WEIGHT``, by the number of words and ``MORE_WORDS``."""
        hits = self.hits(folded) if hits is None else hits
        total = sum(x for _, x in hits)
        return max(0.0, total - FREE_WEIGHT) / (folded.count(" ") - 1 + MORE_WORDS) if hits else 0.0

    def score(self, folded: str, hits: list | None = None) -> float:
        """0 to 1; exactly 0.5, which counts as toxic, at the threshold."""
        d, m = self.density(folded, hits), self.model
        return 0.0 if d <= 0 else 1 / (1 + (m.threshold / d) ** m.steepness)


def _labelled(df: DataFrame, labels: DataFrame, id_col, text_col, label_id, label_col, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled rows, by a hash of the id; all of them if there are fewer."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = labels.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    rows = df.where(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.join(known, "id").select("t", "y")


def learn(df: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_id="doc_id", label_col="toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit the lexicon, the exception phrases and the threshold on labelled rows outside the held-out fifth.

    Counted in Spark; the words and phrases that reach the driver are of about ``max_rows`` rows at most, and each
    stands in several of them. Words have two letters or more. Texts that agree
    in the smallest hash of their words, as copies do, count as one kind, so a word that a copied text repeats
    does not enter the lexicon by its copies. No labelled rows of either label: an empty lexicon.
    """
    rows = stage(_labelled(df, labels, id_col, text_col, label_id, label_col, max_rows), "tox-rows")
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen.get(1) or not seen.get(0):
        return Model()

    def count(piece):
        out: dict = {}
        for t, y in zip(piece.column("t").to_pylist(), piece.column("y").to_pylist()):
            got = {w for w in fold(t).split(" ") if len(w) >= 2}
            kind = min(map(zlib.crc32, (w.encode() for w in got)), default=0) if y else -1
            for w in got:
                out[w, kind] = out.get((w, kind), 0) + 1
        return {"w": [w for w, _ in out], "kind": [k for _, k in out], "n": list(out.values())}

    counts = map_pieces(rows, "t", count, "w string, kind bigint, n bigint").groupBy("w", "kind").agg(F.sum("n").alias("n"))
    odds = counts.groupBy("w").agg(F.count(F.when(F.col("kind") >= 0, 1)).alias("kinds"), F.sum(F.when(F.col("kind") >= 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("kind") < 0, F.col("n")).otherwise(0)).alias("b"))
    ratio = ((F.col("kinds") + 0.1) / seen[1]) / ((F.col("b") + 0.5) / seen[0])
    best = odds.where((F.col("kinds") >= MIN_KINDS) & (ratio >= MIN_RATIO)).select("w", "kinds", ratio.alias("ratio")).collect()
    if not best:
        return Model()
    # a word that shares its texts with none of the others weighs as much as its odds say
    weights = {r["w"]: min(1.0, math.log(r["ratio"]) / math.log(MIN_RATIO * 4)) for r in best}
    model = Model(weights)
    sent = df.sparkSession.sparkContext.broadcast(model)  # words of the labelled rows

    def phrases(piece):
        out: dict = {}
        lex = sent.value.weights
        for t, y in zip(piece.column("t").to_pylist(), piece.column("y").to_pylist()):
            ws = fold(t).split(" ")[1:-1]
            for i, w in enumerate(ws):
                if w in lex:
                    for p in {" ".join(ws[max(0, i - 1) : i + 1]), " ".join(ws[i : i + 2])} - {w}:
                        out[p, y] = out.get((p, y), 0) + 1
        return {"p": [p for p, _ in out], "y": [y for _, y in out], "n": list(out.values())}

    near = map_pieces(rows, "t", phrases, "p string, y int, n bigint").groupBy("p").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("y") != 0, F.col("n")).otherwise(0)).alias("a"))
    model.exceptions = tuple(r["p"] for r in near.where((F.col("b") >= 3) & (F.col("a") == 0)).collect())

    # threshold: the density that parts the labels best, from counts of densities by label on a fixed scale
    sent2, tag = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def dense(piece):
        scorer = _scorer(tag, sent2.value)
        got = [scorer.density(fold(t)) for t in piece.column("t").to_pylist()]
        return {"y": piece.column("y"), "bin": [-1 if d <= 0 else max(0, min(400, int(40 * (math.log10(d) + 7)))) for d in got]}

    bins = {(r["y"], r["bin"]): r["n"] for r in map_pieces(rows, "t", dense, "y int, bin int").groupBy("y", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    score = []
    for b in range(0, 401):
        hit, false = (sum(n for (y, k), n in bins.items() if k >= b and (y == 1) == want) for want in (True, False))
        score.append((2 * hit / (hit + false + seen[1]), b))
    top = max(s for s, _ in score)
    good = [b for s, b in score if s >= top - 0.002]
    model.threshold = 10 ** ((min(good) + max(b for b in good if b <= min(good) + 12)) / 80 - 7)
    return model


def _scorer(tag: str, model: Model) -> Scorer:
    return built(tag, lambda: Scorer(model))


def score(df: DataFrame, model: Model, text_col: str = "text", columns: dict | None = None) -> DataFrame:
    """``columns`` (name in the result -> column) and ``tox_score``, ``tox_hits`` for every row.

    Null, empty or letterless text: score 0. Texts of any length are scored whole.
    """
    columns = columns or {}
    rows = df.select(F.col(text_col).alias("_t"), *[c.alias(k) for k, c in columns.items()])
    sent, tag, names = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, list(columns)  # words and phrases of the labelled rows

    def fn(piece):
        scorer = _scorer(tag, sent.value)
        folded = [fold(t) for t in piece.column("_t").to_pylist()]
        hits = [scorer.hits(f) for f in folded]
        return {**{k: piece.column(k) for k in names}, "tox_score": list(map(scorer.score, folded, hits)), "tox_hits": list(map(len, hits))}

    kinds = dict(rows.dtypes)
    return map_pieces(rows, "_t", fn, ", ".join([f"`{k}` {kinds[k]}" for k in columns] + ["tox_score double, tox_hits bigint"]))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >= 0.5), n_hits.

    Learned from labelled rows whose crc32(id as text) mod 5 is not 0. Rows with null id count as not held out
    and are never learned from. Null and empty texts score 0. Repeated rows give a row each; of repeated labels
    the largest holds. Empty tables: no rows, or an empty lexicon and scores of 0. Other columns are not read.
    """
    model = model or learn(df, labels, id_col, text_col, label_id, label_col)
    out = score(df, model, text_col, {"id": F.col(id_col)})
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_hits").alias("n_hits"))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """``df`` without the rows that score 0.5 or more; row by row where they are read, so ids need not be unique.

    Null and empty texts score 0 and stay, repeated rows are judged alike, empty labels drop nothing. Empty table: no
    rows. Columns of any name are handed on as they are.
    """
    model = model or learn(df, labels, id_col, text_col, label_id, label_col)
    sent, tag = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # words and phrases of the labelled rows

    def keep(texts):
        scorer = _scorer(tag, sent.value)
        return [scorer.score(fold(t)) < 0.5 for t in texts]

    return filter_pieces(df, text_col, keep)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
