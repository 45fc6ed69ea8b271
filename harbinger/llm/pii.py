"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their score.

Spans are in code points, end exclusive. Kinds, in this order: email, ip, card, phone (the base), iban, ssn.
Cards pass Luhn; IBANs pass the mod-97 test and have their country's length; social security numbers need a
word of their context nearby, as digits alone say little. A null or empty text has no spans. Every row gives
one row, whatever its id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from harbinger.llm import common

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
# Each starts where a run starts and never gives back: the leftmost, longest matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_DIGIT = re.compile(r"[0-9]")

#: Lengths of IBANs by country, for the 89 countries of the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Score before context, and words that raise it within WINDOW characters on either side.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|mailto", re.I), "ip": re.compile(r"\bip\b|address|host|server|login", re.I), "card": re.compile(r"card|visa|master|amex|credit|debit|payment|cvv", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|whatsapp", re.I), "iban": re.compile(r"iban|bank|account|konto|transfer", re.I), "ssn": re.compile(r"ssn|social security|tax ?payer", re.I),
}
WINDOW = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """What the patterns propose and the checks confirm, kind by kind."""
    if "@" in text:
        for i, j in emails(text):
            yield "email", i, j
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    return min(1.0, BASE_SCORE[kind] + (0.3 if CONTEXT[kind].search(near) else 0.0))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind, with scores."""
    found = [(k, i, j, score(text, k, i, j)) for k, i, j in base_spans(text)]
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            compact = m[0].replace(" ", "")
            length = IBAN_LENGTHS.get(compact[:2])
            if length and len(compact) > length:  # words in capitals may follow
                keep, seen = 0, 0
                while seen < length:
                    seen += m[0][keep] != " "
                    keep += 1
                ends_here = m.start() + keep
                compact = compact[:length] if m[0][keep : keep + 1] == " " else ""
            else:
                ends_here = m.end()
            if length and len(compact) == length and mod97(compact):
                found.append(("iban", m.start(), ends_here, score(text, "iban", m.start(), ends_here)))
        if "-" in text:
            found += [("ssn", *m.span(), s) for m in _SSN.finditer(text) if (s := score(text, "ssn", *m.span())) >= 0.5]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id and found, an array of (kind, start, end, score)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return common.texts_of(docs, id_col, text_col).transform(common.map_batches, scan, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>")


def digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts per base kind, the hash of the base spans, the text of all spans, and their scores in the same order, which
    nearby words (personal data) or names (secrets) have adjusted."""
    from pyspark.sql import functions as F

    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("found", lambda s: s["kind"].isin(*base))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, base), F.sha2(text(own), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 4)), ",").alias("scores"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return digest(find_personal_data(common.documents(spark, sf_dir)), KINDS[:4])
