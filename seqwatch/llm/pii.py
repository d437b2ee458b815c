"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digits that
touch (directly, by a dot, a blank or a hyphen), ``://`` and words that announce an account.
Each anchor starts a small deterministic parser that expands to the span's borders and checks
it. Parsers skip what an earlier span of their kind has consumed, so a text is read a constant
number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqwatch.llm import kernels

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "account", "login")
KINDS = BASE_KINDS + ADDED_KINDS
ACCOUNT_CUES = ("account", "acct", "customer id", "member id", "passport", "policy number", "tax id", "ssn")

DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A login has no slash before its host, so that no failed one is read past the next ``://``.
LOGIN = re.compile(r"[^\s/?#@:]++(?::[^\s/?#@]*+)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,19}\Z")
IDENTIFIER = re.compile(r"(?: (?:no|nr|number)\b\.?)?[ :#=.]{1,4}([A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])")
IBAN = re.compile(r"[ :#=.]{1,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
# Characters of an IBAN by country, of the public registry.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22,
    DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28,
    IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27,
    MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24,
    SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)

SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,value:string>>"


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("login", 3))
    for a in DIGITS:
        found.add_word("+" + a, ("phone", 2))
        for b in DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(a + between + b, ("card", 2 + len(between)))
    for cue in ACCOUNT_CUES + ("iban",):
        kind = "iban" if cue == "iban" else "account"
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _email(text: str, at: int, limit: int) -> tuple[int, int] | None:
    domain = DOMAIN.match(text, at + 1)
    start = at
    if domain:
        while start > limit and text[start - 1] in LOCAL:
            start -= 1
    return (start, domain.end()) if domain and start < at else None


def _ips(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the dotted digits around ``at`` end, and the addresses in them, four groups each."""
    run = GROUPS.match(text, at)
    found, start = [], at
    groups = run.group().split(".")
    for i in range(0, len(groups) - 3, 4):
        four = groups[i : i + 4]
        end = start + sum(map(len, four)) + 3
        if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in four):
            found.append((start, end))
        start = end + 1
    return run.end(), found


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number of its country's length; capitals that go on after a blank are not part of it."""
    m = IBAN.match(text, at)
    if not m:
        return None
    start, end = m.span(1)
    length = IBAN_LENGTHS.get(m[1][:2])
    if length:
        places = [i for i in range(start, end) if text[i] != " "]
        if len(places) < length:
            return None
        end = places[length - 1] + 1
    if text[end : end + 1].isalnum():
        return None
    plain = text[start:end].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return (start, end) if int(number) % 97 == 1 else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, ordered by start, then kind.

    Base kinds follow fixed patterns, leftmost and without overlap within a kind. Added are
    ``iban`` (after the word, of the country's length, valid check digits), ``account`` (six to eighteen digits after an
    announcing word) and ``login`` (user, password and host of a URL).
    """
    spans: list[tuple[str, int, int]] = []
    if not text:
        return spans
    done = dict.fromkeys(KINDS, 0)
    digits_at = 0  # dotted digits before this are parsed
    for last, (kind, length) in AUTOMATON.iter(text):
        at = last + 1 - length
        if kind == "ip":
            if at >= digits_at:
                while at > digits_at and text[at - 1] in DIGITS:
                    at -= 1
                digits_at, found = _ips(text, at)
                spans.extend(("ip", *s) for s in found)
        elif kind == "card":
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
        elif kind == "phone":
            m = PHONE.match(text, at)
            if m and 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
        elif kind == "email":
            span = _email(text, at, done["email"])
            if span:
                done["email"] = span[1]
                spans.append(("email", *span))
        elif at >= done[kind]:
            if kind == "login":
                m = LOGIN.match(text, last + 1)
                scheme = SCHEME.search(text, max(0, at - 20), at)
                span = (last + 1, m.end()) if m and scheme else None
            else:
                alone = at == 0 or not text[at - 1].isalnum()
                m = IDENTIFIER.match(text, last + 1) if kind == "account" and alone else None
                span = m.span(1) if m else _iban(text, last + 1) if kind == "iban" and alone else None
            if span:
                done[kind] = span[1]
                spans.append((kind, *span))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans make one."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` of every row; null or empty text has none. Other columns are ignored."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])
    )
    batch_of = kernels.record_batches([("doc_id", pa.int64()), ("spans", kind)])

    def rows(text: str | None) -> list[dict]:
        return [{"kind": k, "start": s, "end": e, "base": k in BASE_KINDS, "value": text[s:e]} for k, s, e in find(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in kernels.blocks(batch):
                part = batch.slice(first, end - first)
                yield batch_of(part.column("doc_id"), [rows(t) for t in part.column("text").to_pylist()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """All rows and columns, with personal data in ``column`` replaced by its kind; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for first, end, _, _ in kernels.blocks(batch, column):
                part = batch.slice(first, end - first)
                texts = [redacted(t, find(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, type=part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
