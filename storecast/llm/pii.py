"""Personal data spans: patterns propose, checksums confirm, nearby context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storecast.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: A proposed span beyond the base ones is reported from this score on.
THRESHOLD = 0.7
#: Characters before and after a span that are searched for context words.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_LONG = re.compile(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]{4}){2})")
# Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
_REST = {n: re.compile(r"(?:\x20?[A-Z0-9]{4}){%d}%s(?![A-Za-z0-9])" % ((n - 4) // 4, r"\x20?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")) for n in range(12, 36)}
_GROUPED_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?P<s>[\x20-])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.,/-])\(?0[0-9][\x20()/0-9-]{6,16}[0-9](?![\w-])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

# Words that make a kind likelier nearby.
CONTEXT_WORDS = {
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "téléphone", "teléfono", "llamar"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
}
_WORDS = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b") for k, v in CONTEXT_WORDS.items()}
#: Score of a confirmed proposal without context, and what a context word nearby adds.
BASE_SCORES = {"email": 0.95, "ip": 0.75, "card": 0.75, "phone": 0.75}
SCORES = {"iban": 0.8, "card": 0.5, "phone": 0.4, "ssn": 0.4}
CONTEXT_BONUS = 0.35

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go to the end, letters become 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @: its local part is the longest run before it."""
    start, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > start and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at) if left < at else None
        if m:
            yield "email", left, m.end()
            start = m.end()
        at = text.find("@", max(start, at + 1))


def base_spans(text: str) -> list[Span]:
    """Email, IP, payment card and international phone spans, by start, then kind."""
    out = list(_emails(text))
    if _NUMBERS.search(text):
        if _DOTTED.search(text):
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        if _LONG.search(text):
            for m in _CARD.finditer(text):
                if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _ibans(text: str) -> Iterator[Span]:
    """Confirmed IBANs of their country's length, or of the longest that is confirmed if the country isn't listed."""
    upto = 0
    for head in _IBAN.finditer(text):
        if head.start() < upto:
            continue
        known = IBAN_LENGTHS.get(head[0][:2])
        for n in (known,) if known else sorted(_REST, reverse=True):
            m = _REST[n].match(text, head.end())
            if m and mod97(text[head.start():m.end()]):
                upto = m.end()
                yield "iban", head.start(), upto
                break


def _context(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT):start].lower() + " " + text[end:end + CONTEXT].lower()
    return CONTEXT_BONUS if kind in _WORDS and _WORDS[kind].search(near) else 0.0


def scored_spans(text: str) -> tuple[list[Span], list[tuple[Span, float]]]:
    """Base spans, and all spans with their scores: the base ones and further confirmed ones that overlap none."""
    base = base_spans(text)
    scored = [(s, min(1.0, BASE_SCORES[s[0]] + _context(text, *s))) for s in base]
    if _LONG.search(text):
        proposed = list(_ibans(text))
        proposed += [("card", *m.span()) for m in _GROUPED_CARD.finditer(text) if luhn(_digits(m[0]))]
        proposed += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 13]
        proposed += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        taken = [(s[1], s[2]) for s in base]
        for s in proposed:
            score = SCORES[s[0]] + _context(text, *s)
            if score >= THRESHOLD and not any(a < s[2] and s[1] < b for a, b in taken):
                scored.append((s, score))
                taken.append((s[1], s[2]))
    return base, sorted(scored, key=lambda x: (x[0][1], ORDER[x[0][0]]))


def join_spans(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, upto = [], 0
    merged: list[list] = []
    for (kind, a, b), _ in scored_spans(text)[1]:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[upto:a], f"<{kind.upper()}>"]
        upto = b
    return "".join([*out, text[upto:]]) if merged else text


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, the digest of the base spans, all spans and their scores.

    Offsets are code points, ends exclusive. A null text counts as empty (no spans); a null id stays
    null; repeated rows give repeated results; other columns are not read. Each row is handled alone,
    so the job has no shuffle and every text is scanned whole.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
        T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                base, scored = scored_spans(text.as_py() or "")
                kinds = [s[0] for s in base]
                values = (*[kinds.count(k) for k in KINDS[:4]], hashlib.sha256(join_spans(base).encode()).hexdigest(),
                          join_spans(s for s, _ in scored), [round(x, 4) for _, x in scored])
                for column, value in zip(rows, values):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(rows, types)]], names=schema.fieldNames())

    return map_arrow(docs.select(id_col, text_col), run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col`` and ``length_col`` (if there is one) counted anew.

    All rows and columns stay; a null text stays null.
    """
    names = docs.columns
    at = names.index(text_col)
    n_at = names.index(length_col) if length_col in names else None
    out_type = None if n_at is None else docs.schema[length_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [None if t is None else redact(t) for t in map(lambda x: x.as_py(), batch.column(at))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if n_at is not None and isinstance(out_type, (T.LongType, T.IntegerType)):
                old = batch.column(n_at).to_pylist()
                columns[n_at] = pa.array([o if t is None else len(t) for o, t in zip(old, texts)], batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)
