"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from tracklake.llm.common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "phone_local")

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: one that fails there fails further right in the run as well.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
PHONE_LOCAL = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
HAS_DIGIT = re.compile(r"[0-9]")

# The score a confirmed pattern starts from, and the words that raise it.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "phone_local": 0.4}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "tax"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "contact"),
}
AGAINST = ("version", "isbn", "example", "order", "serial", "sku")
RAISE, LOWER, NEAR = 0.3, 0.2, 40  # score steps, and the code points looked at on either side
LIMIT = 0.5                        # least score of a span the method adds; base spans stay whatever their score

RESULT = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "found array<struct<kind:string,start:int,end:int,score:double>>")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod97(code: str) -> bool:
    """The account check: country and check digits last, letters as 10 to 35, remainder 1."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Confirmed account numbers, leftmost first. Where the longest candidate fails the check, its shorter ends before
    spaces are tried, the longer first, so that a bank code or a number that follows hides no account number."""
    found, at = [], 0
    while match := IBAN.search(text, at):
        start, longest = match.span()
        ends = [longest] + [e for e in range(longest - 1, start + 14, -1) if text[e] == " "]
        end = next((e for e in ends if mod97(text[start:e])), None)
        if end:
            found.append((start, end))
        at = end or start + 4
    return found


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ signs so that long runs cost no second look."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        local = len(head) - len(head.rstrip(LOCAL_PART))
        match = DOMAIN.match(text, at) if local else None
        if match:
            found.append((at - local, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of every kind, kinds as listed, then by start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not HAS_DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text)
                if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text)
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out += [("iban", *span) for span in ibans(text)]
    if "-" in text:
        out += [("ssn", *m.span()) for m in SSN.finditer(text)]
    out += [("phone_local", *m.span()) for m in PHONE_LOCAL.finditer(text)]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()
    words = set(re.findall(r"[a-z-]+", around))
    value = START[kind] + RAISE * any(w in words for w in CONTEXT[kind]) - LOWER * any(w in words for w in AGAINST)
    return round(min(1.0, max(0.0, value)), 2)


def digest(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans kept: the base kinds, and those of the further kinds that score and overlap no base span."""
    scored = [(*span, score(text, *span)) for span in proposed(text)]
    base = [s for s in scored if s[0] in BASE_KINDS]
    taken = sorted((s[1], s[2]) for s in base)
    more, i = [], 0
    for s in sorted((s for s in scored if s[0] not in BASE_KINDS), key=lambda s: s[1]):
        while i < len(taken) and taken[i][1] <= s[1]:
            i += 1
        clear = not any(a < s[2] and b > s[1] for a, b in taken[i:i + len(BASE_KINDS)])
        if s[3] >= LIMIT and (clear or s[0] == "iban"):
            more.append(s)
    return base + sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))


def judge(text: str) -> tuple:
    spans = find(text)
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
    return (*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans),
            [dict(zip(("kind", "start", "end", "score"), s)) for s in spans])


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are masked as one."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their digest, all spans, and the spans with scores.

    Null texts count as empty and have no spans. Repeated rows are searched each; a null id is passed on; an empty
    table gives an empty result; other columns are not read. Spans are in code points, end exclusive. All patterns
    read a text in time linear to its length. One scan without a shuffle."""
    return map_texts(docs, judge, RESULT, id_col, text_col)
