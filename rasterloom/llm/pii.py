"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: The four base patterns, in parts. Possessive forms match the same strings, without retries from inside a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Signs of an account number by country, from the public register; elsewhere any length from 15 to 34 will do.
_IBAN_SIGNS = {x[:2]: int(x[2:]) for x in """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22
GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31
MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24
XK20 YE30""".split()}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: A name that says what follows is a secret, and 16 signs or more of it.
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|credential|(?:api|access|private|secret)[_ -]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([a-z0-9+/_.=-]{16,})")
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
BASE = 4  # the first four kinds are the base: they stay, whatever their score
#: Prior score of a confirmed span of each kind. A word nearby that speaks for the kind adds 0.3, one that speaks against it takes 0.3 away.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "national_id": 0.4, "secret": 0.8}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "cvv"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "national_id": ("ssn", "social security", "national id"),
    "secret": ("login", "auth", "bearer", "credentials"),
}
AGAINST = {
    "email": (),
    "ip": ("version", "release", "section"),
    "card": ("order", "tracking", "isbn", "serial"),
    "phone": ("order", "isbn", "serial"),
    "iban": ("example", "serial", "product key"),
    "national_id": ("order", "part", "serial", "isbn"),
    "secret": ("example", "placeholder", "dummy"),
}
_NEARBY = {k: [re.compile(rf"(?<![^\W_])(?:{'|'.join(w)})(?![^\W_])") if w else None for w in (CONTEXT[k], AGAINST[k])] for k in KINDS}
NEAR = 40  # signs before and after a span in which a context word counts
LEAST = 0.5  # added kinds below this are dropped


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches: an address begins as early as its local part's signs reach back, and not before the last match's end."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    """At each start the ends at word boundaries: where the country fixes a length, that one and then the farthest; else every one, the farthest first."""
    at = 0
    while m := _IBAN.search(text, at):
        begin, end, signs, ends = m.start(), m.start(), 0, {}
        while signs < 34:
            step = end + (signs > 0 and text[end : end + 1] == " ")
            c = text[step : step + 1]
            if not (c and c.isascii() and (c.isdigit() or c.isupper())):
                break
            end, signs = step + 1, signs + 1
            c = text[end : end + 1]
            if signs >= 15 and not (c.isascii() and c.isalnum()):
                ends[signs] = end
        far = sorted(ends, reverse=True)
        fixed = _IBAN_SIGNS.get(m[0][:2])
        tried = far if fixed is None else [n for n in (fixed, *far[:1]) if n in ends]
        found = next((ends[n] for n in tried if mod97(text[begin : ends[n]])), None)
        if found:
            yield begin, found
        at = found or begin + 4


def _random(s: str) -> bool:
    """The check of a secret: letters and digits, and eight signs that differ."""
    return len(set(s)) >= 8 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def spans_of(text: str) -> list[tuple[int, int, str, float]]:
    """(begin, end, kind, score), by begin, then in the order of KINDS. Offsets are code points, end exclusive."""
    out: list[tuple[int, int, int]] = [(s, e, 0) for s, e in _emails(text)]
    if any(c in text for c in "0123456789"):
        if "." in text:
            out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        out += [(s, e, 4) for s, e in _ibans(text)]
        if "-" in text:
            out += [(m.start(), m.end(), 5) for m in _NATIONAL.finditer(text)]
        out += [(m.start(1), m.end(1), 6) for m in _SECRET.finditer(text) if _random(m[1])]
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    scored = [(s, e, KINDS[k], _score(text, s, e, KINDS[k])) for s, e, k in out]
    return [x for x in scored if x[2] in KINDS[:BASE] or x[3] >= LEAST]


def _score(text: str, begin: int, end: int, kind: str) -> float:
    near = (text[max(0, begin - NEAR) : begin] + " " + text[end : end + NEAR]).lower()
    up, down = (bool(w and w.search(near)) for w in _NEARBY[kind])
    return round(min(1.0, PRIOR[kind] + 0.3 * up - 0.3 * down), 2)


_SPAN = "array<struct<begin:int,end:int,kind:string,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, detections): for each row of ``docs`` its spans, with scores.

    Null and empty texts have none; a very long text is read whole by one task; overlapping spans all stay, and of those
    with one beginning the kinds go in the order of KINDS; repeated rows and null ids stay; other columns are left behind;
    an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            found = [[dict(zip(("begin", "end", "kind", "score"), x, strict=True)) for x in spans_of(t or "")] for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
            yield pa.record_batch([b.column(0), pa.array(found, kind)], ["doc_id", "detections"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("doc_id"), column(text).alias("text")).mapInArrow(run, f"doc_id {kind}, detections {_SPAN}")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``detections``, and the scores of all spans, in their order. A row without detections has counts of 0 and empty texts."""
    name = lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))
    base = F.filter("detections", lambda x: x["kind"].isin(*KINDS[:BASE]))
    joined = lambda a: F.array_join(F.transform(a, name), ",")
    count = lambda k: F.size(F.filter("detections", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("detections")).alias("spans"), F.array_join(F.transform("detections", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))


def redacted(text: str) -> str:
    """Each span becomes its kind in angle brackets; of overlapping spans the earlier one's name stands for both."""
    out, at = [], 0
    for begin, end, kind, _ in spans_of(text):
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; null stays null, and all rows and columns stay in place, whatever their names."""

    @F.arrow_udf("string")
    def clean(texts):
        return pa.array((redacted(t.as_py()) if t.is_valid else None for t in texts), pa.string())

    return docs.withColumn(text, clean(column(text)))


def digest(spans: list[tuple[int, int, str, float]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans if k in KINDS[:BASE]).encode()).hexdigest()
