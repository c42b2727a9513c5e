"""Plain Python forms of the base span rules, for comparison."""

import hashlib
import re

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def pii(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if _ok(k, m.group())]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    """Base spans of the secret scan, by start, then kind as listed."""
    plain = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, holds) in enumerate(plain) for m in re.finditer(pattern, text) if holds(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]
