"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes, and cues of identifiers and addresses.
Deterministic local parsers expand an anchor to its boundaries and validate what they find: an email from its
at-sign, a phone number from its plus sign, a card number or dotted address from its first digit. The base kinds
(email, ip, card, phone) follow the grammar of ``find_pii``; the method adds ``url``, ``iban``, ``account``,
``secret``, ``ssn`` and ``street``. An anchor inside what its kind's parser has read is passed over, so every parser
reads a text once.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret", "ssn", "street")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile("[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^\x00-\x20]+")
_IBAN = re.compile(r"[ :=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ ]?(?:no\.?|number|nr\.?|id|#))?[ :=#]{1,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_SECRET = re.compile(r"[ ]?[:=][ ]?[\"']?([^\s\"',;]{6,})")
_SSN = re.compile(r"[ :=#]{0,3}(?:no\.?|number)?[ :=#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-Z][^\W\d_]*){1,4}$")
_AKIA = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
CUES = {"@": "email", "+": "phone", **dict.fromkeys("0123456789", "digit"), "http://": "url", "https://": "url", "ftp://": "url", "mailto:": "url", "iban": "iban", "account": "account", "acct": "account", "konto": "account", "password": "secret", "passwd": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret", "AKIA": "key", "ssn": "ssn", "social security": "ssn", " Street": "street", " Avenue": "street", " Road": "street", " Lane": "street", " Boulevard": "street"}
_AUTO: list = []


def _automaton():
    if not _AUTO:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for cue, kind in CUES.items():
            for form in {cue} if kind in ("street", "key") or len(cue) == 1 else {cue, cue.upper(), cue.capitalize()}:
                auto.add_word(form, (kind, len(form)))
        auto.make_automaton()
        _AUTO.append(auto)
    return _AUTO[0]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str, ats) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    No local part holds an at-sign, so each at-sign has one longest local part, back to what stands before it
    or to the end of the last match, and one domain.
    """
    out, last = [], 0
    for at in ats:
        if at < last:
            continue
        m = _DOMAIN.match(text, at + 1)
        if not m:
            continue
        i = at
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < at:
            out.append((i, m.end()))
            last = m.end()
    return out


def _ip_ok(span: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in span.split(".")))


def _card_ok(span: str) -> bool:
    digits = span.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def find(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each (kind, start, end) by start, then kind as listed in ``KINDS``, then end."""
    if not text:
        return [], []
    ats, base, more = [], [], []
    done = dict.fromkeys([*KINDS, "key"], 0)  # where the next match of a kind may begin
    for end, (kind, n) in _automaton().iter(text):
        start, end = end + 1 - n, end + 1
        if kind == "digit":
            if start >= done["card"]:
                m = _CARD.match(text, start)
                done["card"] = m.end() if m else end
                if m and m.end() - start >= 14 and _card_ok(m[0]):
                    base.append(("card", start, m.end()))
            if start >= done["ip"]:
                m = _IP.match(text, start)
                done["ip"] = m.end() if m else _DIGITS.match(text, start).end()  # no other place of the run can begin one
                if m and _ip_ok(m[0]):
                    base.append(("ip", start, m.end()))
        elif kind == "email":
            ats.append(start)
        elif kind == "phone":
            if m := _PHONE.match(text, start):  # no phone number holds a plus sign, so none overlap
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    base.append(("phone", start, m.end()))
        elif start < done[kind] or kind != "street" and start and text[start - 1].isalnum():
            continue
        elif kind == "url":
            if m := _URL.match(text, end):
                done["url"], stop = m.end(), end + len(m[0].rstrip(".,;:!?)]*"))
                if stop > end:
                    more.append(("url", start, stop))
        elif kind == "key":
            if m := _AKIA.match(text, start):
                done["key"] = m.end()
                more.append(("secret", start, m.end()))
        elif kind == "street":
            line = text.rfind("\n", max(0, start - 60), start) + 1 or max(0, start - 60)
            if (m := _HOUSE.search(text[line:start])) and (line + m.start() == 0 or not text[line + m.start() - 1].isalnum()) and not text[end : end + 1].isalnum():
                more.append(("street", line + m.start(), end))
        elif m := {"iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET, "ssn": _SSN}[kind].match(text, end):
            done[kind] = m.end(1)
            if kind != "iban" or _iban_ok(m[1]):
                more.append((kind, m.start(1), m.end(1)))
    base += [("email", a, b) for a, b in _emails(text, ats)]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base.sort(key=order)
    return base, sorted({*base, *more}, key=order) if more else base


def show(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Base kinds, leftmost and not overlapping in a kind: email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``;
    ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255; card ``[0-9]([\\x20-]?[0-9])+`` of 14 to
    19 digits that pass Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` of 10 to 15 digits. Spans of other kinds may overlap
    them. Offsets are code points, end exclusive. Null and empty text: no spans. Texts of any length are read whole;
    every parser takes time in proportion to the text. Spans that begin alike stand in the order of kinds. Repeated
    rows give a row each. Empty table: no rows. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def fn(piece):
        got = [find(t) for t in piece.column("t").to_pylist()]
        return {"id": piece.column("id"), **{f"n_{k}": [sum(s[0] == k for s in b) for b, _ in got] for k in BASE}, "base_sha256": [hashlib.sha256(show(b).encode()).hexdigest() for b, _ in got], "spans": [show(a) for _, a in got]}

    out = map_pieces(rows, "t", fn, f"id {dict(rows.dtypes)['id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
