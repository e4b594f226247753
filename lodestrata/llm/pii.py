"""Personal data (op 6): patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and never depend on context. The method adds bank
account numbers (mod-97) and social security numbers, the latter only with a word of their kind nearby.

Defined results: a null text has no spans; repeated rows give repeated results; an empty table gives an empty
table; texts are searched whole and every pattern takes time in proportion to the text; spans of one start go by kind as
listed; columns that are kept may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.common import fields, quoted, text_map

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Characters on either side in which context words count, and the score from which an added span is kept.
REACH, KEEP = 48, 0.6

# Base score by kind, words that raise it, words that lower it.
SCORE = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85, "ssn": 0.35}
RAISE = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "address", "host", "server", "client", "login"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "number"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "contact"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
LOWER = {"example", "sample", "test", "dummy", "version", "isbn", "order"}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT, _WORD, _GAPS = re.compile("[0-9]"), re.compile(r"[a-z]+"), str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    rest = 0
    for c in moved:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def emails(text: str):
    """Leftmost matches of local part, @ and dotted domain: from each @ the local part is taken backwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def proposed(text: str):
    """(kind, start, end) of confirmed spans."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].translate(_GAPS)
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(_GAPS)) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    words = set(_WORD.findall(near.lower()))
    return round(min(1.0, max(0.0, SCORE[kind] + 0.3 * bool(words & RAISE[kind]) - 0.3 * bool(words & LOWER))), 3)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed; added kinds only from the score KEEP."""
    spans = [(a, b, k, score(text, k, a, b)) for k, a, b in proposed(text)]
    kept = [x for x in spans if x[2] in BASE or x[3] >= KEEP]
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Each span, overlapping ones together, replaced by the kind of the first in brackets."""
    out, last, end = [], 0, -1
    for a, b, kind, _ in spans:
        if a < end:
            if b > end:
                end = last = b
            continue
        out += [text[last:a], f"[{kind.upper()}]"]
        end = last = b
    return "".join([*out, text[last:]])


SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", redacted: bool = False, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """doc_id, pii (spans with kind and score) and, if asked, the redacted text; columns in ``keep`` come along, and
    ``prefix`` goes before the names of the new ones, so that kept columns may have them."""
    names = tuple(dict.fromkeys((doc_id, *keep)))
    schema = fields(df, names, f"{quoted(prefix + 'pii')} {SPANS}" + f", {quoted(prefix + 'redacted')} string" * redacted)

    def make():
        def kernel(texts, kept):
            found = [find(t) for t in texts]
            out = {**kept, prefix + "pii": [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in f] for f in found]}
            if redacted:
                out[prefix + "redacted"] = [redact(t, f) for t, f in zip(texts, found, strict=True)]
            return out

        return kernel

    return text_map(df, schema, make, text, names)


def joined(spans, only=None):
    """kind:start:end of spans in order, comma-joined."""
    kept = spans if only is None else F.filter(spans, only)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts by kind and the spans as text."""
    pii = F.col("pii")
    count = lambda kind: F.size(F.filter(pii, lambda x: x["kind"] == kind)).cast("long")
    base = joined(pii, lambda x: x["kind"].isin(*BASE))
    risk = F.coalesce(F.array_max(F.transform(pii, lambda x: x["score"])), F.lit(0.0))
    return found.select(F.col(doc_id).alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(pii).alias("spans"), risk.alias("risk"))


