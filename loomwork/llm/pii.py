"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust their score, and the score decides.

The four base kinds are found by linear scans that give the leftmost non-overlapping matches of their expressions; base spans always stay,
whatever their score. Spans that the method adds stay if their score reaches ``KEEP``: ``iban`` (length by country, mod-97), ``secret`` (keys and tokens of known
shape, and values assigned to a name such as token or password), ``ssn`` (numbers in the form of a US social security number), ``card`` numbers of 13 to 15 digits and
``phone`` numbers without a plus, which only reach it where a context word stands near.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
# Possessive and anchored forms of the expressions: same matches, linear time on any text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9+A-Za-z])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}(?![0-9])")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=[ ]?[A-Za-z0-9])")
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
KEY_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Shapes of keys and tokens by issuer, and values assigned to a telling name.
SHAPES = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|"
    r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])"
)
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?)[\"']?\s{0,3}(?:=|:|=>)\s{0,3}([\"']?)([A-Za-z0-9+/_.~!@#$%^&*=-]{8,})")
#: Lengths of IBANs by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Context words by kind, the score before context, what a context word adds.
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|adresse|dirección)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|carte|karte|kreditkarte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|téléphone|portable|telefon|handy|rufnummer|teléfono|móvil|llame)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|transfer|compte|banque|konto|überweisung|cuenta|banco)\b"),
    "secret": re.compile(r"(?i)\b(?:token|secret|password|key|credential|login|passwort|contraseña|mot de passe)"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax|taxpayer)\b"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.8, "ssn": 0.6}
#: Of forms that no checksum or plus sign confirms.
WEAK = {"card": 0.4, "phone": 0.4, "secret": 0.5}
LIFT = 0.15
KEEP = 0.5
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Every @ whose left neighbour run and right domain match; the run may not reach back into the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Every head of a known country whose number, in single-spaced groups, ends at the country's length and passes mod-97."""
    out, done = [], 0
    for m in IBAN_HEAD.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2].upper())
        if length is None or m.start() < done:
            continue
        solid, at = m[0], m.end()
        while len(solid) < length and at < len(text):
            if text[at] == " " and text[at - 1] != " ":
                at += 1
            elif text[at].isascii() and text[at].isalnum():
                solid += text[at]
                at += 1
            else:
                break
        ends = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if len(solid) == length and text[at - 1] != " " and ends and mod97(solid.upper()):
            out.append((m.start(), at))
            done = at
    return out


def secrets(text: str) -> list[tuple[int, int, float]]:
    """Private key blocks, tokens of known shape, and assigned values with letters and digits and 6 or more distinct characters; with their scores before context."""
    out: list[tuple[int, int, float]] = []
    if "-----BEGIN " in text:
        stops = [m.end() for m in KEY_END.finditer(text)]
        for m in KEY_BEGIN.finditer(text):
            k = bisect_left(stops, m.end())
            if not out or m.start() >= out[-1][1]:
                out.append((m.start(), stops[k] if k < len(stops) else m.end(), PRIOR["secret"]))
    out += [(m.start(), m.end(), PRIOR["secret"]) for m in SHAPES.finditer(text)]
    for m in ASSIGNED.finditer(text):
        value = m[2]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 6:
            out.append((m.start(2), m.end(2), WEAK["secret"]))
    return apart(sorted(out, key=lambda s: (s[0], -s[1])), [])


def apart(spans: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Spans, sorted by start, that overlap neither a taken one nor one before them: one walk along both lists. Where some are taken, the spans must not overlap each other."""
    out, k, done = [], 0, 0
    taken = sorted(taken)
    reach = 0  # the farthest end of taken spans that start before the span's end
    for s in spans:
        while k < len(taken) and taken[k][0] < s[1]:
            reach = max(reach, taken[k][1])
            k += 1
        if s[0] >= reach and s[0] >= done:
            out.append(s)
            done = s[1]
    return out


def near(text: str, kind: str, start: int, end: int) -> bool:
    return bool(CONTEXT[kind].search(text, max(0, start - WINDOW), start)) or bool(CONTEXT[kind].search(text, end, min(len(text), end + WINDOW)))


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans, and all spans with their scores; both by kind as in KINDS, then start."""
    if not text:
        return [], []
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int, float]] = []  # with the score before context
    if "@" in text:
        base += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        base += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in DIGITS.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    if len(digits) >= 16:
                        base.append(("card", m.start(), m.end()))
                    else:
                        more.append(("card", m.start(), m.end(), WEAK["card"]))
        if "+" in text:
            base += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        more += [("ssn", m.start(), m.end(), PRIOR["ssn"]) for m in SSN.finditer(text)]
        more += [("iban", a, b, PRIOR["iban"]) for a, b in ibans(text)]
        taken = [(a, b) for k, a, b, *_ in [*base, *more] if k != "email"]
        national = [(m.start(), m.end()) for m in NATIONAL.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 12 and not DATE.fullmatch(m[0])]
        more += [("phone", a, b, WEAK["phone"]) for a, b in apart(national, taken)]
        more += [("secret", a, b, p) for a, b, p in secrets(text)]
    order = {k: i for i, k in enumerate(KINDS)}
    scored = [(k, a, b, min(1.0, p + LIFT * near(text, k, a, b))) for k, a, b, p in more]
    every = [(k, a, b, min(1.0, PRIOR[k] + LIFT * near(text, k, a, b))) for k, a, b in base] + [s for s in scored if s[3] >= KEEP]
    base.sort(key=lambda s: (order[s[0]], s[1]))
    return base, sorted(every, key=lambda s: (order[s[0]], s[1]))


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """Replace every span by its kind in brackets; of overlapping spans the one that starts first, then the longer, names the place."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", redacted: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``pii_base`` and ``pii_spans`` (arrays of kind, start, end; the second with scores), and the redacted text where a name is given.

    Null or empty texts have no spans; a null stays null when redacted. Positions are code points, ends exclusive.
    """

    def kernel(texts: list) -> list:
        found = [spans_of(t) for t in texts]
        base = [[{"kind": k, "start": a, "end": b} for k, a, b in f[0]] for f in found]
        every = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in f[1]] for f in found]
        return [base, every] + ([[redact(t, f[1]) for t, f in zip(texts, found)]] if redacted else [])

    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    fields = [
        ("pii_base", "array<struct<kind:string,start:bigint,end:bigint>>", pa.list_(pa.struct(span))),
        ("pii_spans", "array<struct<kind:string,start:bigint,end:bigint,score:double>>", pa.list_(pa.struct([*span, ("score", pa.float64())]))),
    ]
    return append_columns(docs, kernel, fields + ([(redacted, "string", pa.string())] if redacted else []), text, keep)


def joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs.select("doc_id", "text"), keep=["doc_id"]).select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans")
    )
