"""Plain Python version of the secret scan: matches by ``re``, exact error function, thresholds over all tokens."""

import hashlib
import math
import re
from collections import Counter

from tracklake.llm.secret_scan import BASE_KINDS, DEEPEST, GRID, RANDOM_LEVEL, RATE, SIZES, SYMBOLS, departure

PATTERNS = {"assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
            "access": re.compile(r"()(AKIA[A-Z0-9]+)"), "hex": re.compile(r"()([0-9a-f]+)")}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def base_spans(text):
    found = [(kind, *m.span()) for kind, pattern in PATTERNS.items() for m in pattern.finditer(text) if len(m[2]) >= LEAST[kind]]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def candidates(text):
    return [m.span() for m in re.finditer(r"([A-Za-z0-9+/_-]+)={0,2}", text) if len(m[1]) >= 20]


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(plain):
    one_case = plain in (plain.lower(), plain.upper())
    for name, extra in (("hex", ""), ("base36", ""), ("base62", ""), ("base64", ""), ("base64url", "-_")):
        alphabet = SYMBOLS[:62] + extra if extra else SYMBOLS[:SIZES[name]]
        if set(plain.lower() if name in ("hex", "base36") and one_case else plain) <= set(alphabet):
            return name
    return "base64"


def battery(token):
    """(encoding, p_random, p_ordinary)."""
    text = token.rstrip("=")
    encoding = encoding_of(text)
    text = text.lower() if encoding in ("hex", "base36") else text.translate(str.maketrans("-_", "+/"))
    codes, k, n = [SYMBOLS.index(c) for c in text], SIZES[encoding], len(text)
    counts = Counter(codes)
    chi = sum((counts[c] - n / k) ** 2 for c in range(k)) * k / n
    uniform = tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    ups = sum(c >= k / 2 for c in codes)
    if 0 < ups < n:
        mean = 1 + 2 * ups * (n - ups) / n
        runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(codes, codes[1:]))
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1))))
    else:
        p_runs = 2.0 ** (1 - n)
    mid = sum(codes) / n
    around = sum((c - mid) ** 2 for c in codes)
    lag = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:])) / around if around > 1e-6 else 1.0
    p_serial = 2 * tail(abs(lag + 1 / n) * math.sqrt(n))
    far = n * departure(encoding)
    p_uniform_text = tail((k - 1 + far - chi) / math.sqrt(2 * (k - 1 + 2 * far)))
    digits = sum(c < 10 for c in codes)
    borders = sum((a < 10) != (b < 10) for a, b in zip(codes, codes[1:]))
    p_borders = math.exp(-max(0, borders - 2)) if 0 < digits < n and digits >= n * 10 / k / 4 else 1.0
    return encoding, min(1.0, 3 * min(uniform, p_runs, p_serial)), min(1.0, 2 * min(p_uniform_text, p_borders))


def step_of(p):
    return min(DEEPEST * GRID, int(-math.log10(max(p, 1e-300)) * GRID))


def threshold(steps, rate=RATE):
    total, reached, best = sum(steps.values()), 0, None
    for step in sorted(steps, reverse=True):
        reached += steps[step]
        if total * 10 ** (-step / GRID) <= rate * reached:
            best = step
    return best


def scan(rows, rate=RATE):
    """[(id, counts by kind, base digest, spans)] of [(id, text)]."""
    tested = [[(s, e, *battery((t or "")[s:e])) for s, e in candidates(t or "")] for _, t in rows]
    limits = {name: threshold(Counter(step_of(x[4]) for row in tested for x in row if x[2] == name and x[3] >= RANDOM_LEVEL), rate) for name in SIZES}
    out = []
    for (i, text), tokens in zip(rows, tested):
        base = base_spans(text or "")
        added = [("random", s, e) for s, e, name, random, ordinary in tokens if random >= RANDOM_LEVEL and limits[name] is not None
                 and step_of(ordinary) >= limits[name] and not any(b[1] < e and s < b[2] for b in base)]
        order = sorted(base + added, key=lambda s: (s[1], (*BASE_KINDS, "random").index(s[0])))
        write = lambda spans: ",".join(":".join(map(str, s)) for s in spans)
        out.append((i, *[sum(b[0] == kind for b in base) for kind in BASE_KINDS], hashlib.sha256(write(base).encode()).hexdigest(), write(order)))
    return out
