"""The trees that judge candidates of personal data: features, training lines, boosting, calibration.

Trained on the driver on lines written by rule, of which each holds known spans.
Candidates come from the plain generators here, so that sub-runs and
neighbours of a planted span are its negatives. The trees become Column
expressions in :mod:`pii`.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

from .common import LOWER, UPPER

KINDS = ["payment", "telephone", "identity", "secret", "mail"]
CONTEXT = 24
LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS, LEAST_TOKEN = 7, 19, 6, 16
#: Patterns that need no look-around, as both engines read them.
SPELLED = r"[A-Za-z0-9._%+-]+(?: ?\((?i:at)\) ?[A-Za-z0-9-]+(?:(?: ?\((?i:dot)\) ?| (?i:dot) |\.)[A-Za-z0-9-]+)+| (?i:at) [A-Za-z0-9-]+(?: (?i:dot) [A-Za-z0-9-]+)+)"
PLAIN_TOKEN = r"[A-Za-z._%+():/-]*[0-9@][A-Za-z0-9._%+@():/-]*"
REGION = rf"(?:{SPELLED}|{PLAIN_TOKEN})(?: +(?:[().+-]+ +)*(?:{SPELLED}|{PLAIN_TOKEN}))*"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN, TOKEN_LONG, NUMBER_LONG = "[A-Za-z0-9_-]+", "[A-Za-z0-9_-]{16}", r"[0-9](?:[ .()-]{0,3}[0-9]){6}"
#: What may stand between two groups of one number; what glues a candidate to the text around it.
BETWEEN, GLUED, TAIL = r"^[ .()-]{1,3}\z", r"[a-z0-9_.#/@%-]\z", "^[A-Za-z_@%]"
BRACKET, PLUS = r"\(\z|\)", r"\+\z"
PREFIX = "^(sk|pk|gh[pous]|xox[a-z]|AKIA|AIza|eyJ|glpat)"
STOP = r"^(look|arrived?|meet|met|stay|works?|is|was|be|are|him|her|them|it|us|you|the|a|not|and|or) |dot (matrix|product|plot|line|on|in|the|a)$"
CONTEXT_WORDS = {
    "calls": "(phone|tel|call|mobile|cell|fax|ring|whatsapp|dial|hotline|anruf|rufen|appel)",
    "persons": "(ssn|social|passport|account|acct|driver|tax id|national|insurance|dob|ausweis|konto|compte|cuenta)",
    "pays": "(card|visa|master|amex|credit|debit|karte|carte|tarjeta|cvv)",
    "hides": "(token|secret|key|passw|pwd|auth|bearer|api|credential)",
    "writes": "(mail|write|contact|reach|schreib|correo|courriel)",
    "goods": "(order|invoice|isbn|issn|version|page|article|build|part|model|serial|item|sku|ref|commit|sha|md5|rev|ticket|figure|table|doi|uuid|file|path)",
}
FEATURES = [
    "digits", "groups", "first", "last", "most", "hyphens", "dots", "spaces", "bracket", "plus", "luhn", "zero", "year", "inner", "more", "tail",
    "token", "length", "numbers", "hex", "turns", "mixed", "prefix", "spelled", "stop", "glued", *CONTEXT_WORDS,
]
_SMALL = str.maketrans(UPPER, LOWER)


def _flag(pattern: str, text: str) -> int:
    """Does a pattern occur? It is written for engines that call the very end z."""
    return int(bool(re.search(pattern.replace(r"\z", r"\Z"), text)))


def passes_luhn(digits: str) -> bool:
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(t - 9 * (t > 9) for t in twice) % 10 == 0


def plain_candidates(region: str, before: str) -> list[tuple[int, int, dict[str, int]]]:
    """(start, end, features other than zero) of every candidate of a region."""
    out = []

    def add(start: int, end: int, near: str, known: dict[str, int]) -> None:
        context = near[-CONTEXT:].translate(_SMALL)
        known |= {name: _flag(p, context) for name, p in CONTEXT_WORDS.items()}
        out.append((start, end, known | {"glued": _flag(GLUED, context)}))

    groups, at = [], 0
    for m in re.finditer("[0-9]+", region):
        groups.append((m.start(), m.end(), m[0], region[at : m.start()]))
        at = m.end()
    joins = [i > 0 and bool(_flag(BETWEEN, g[3])) for i, g in enumerate(groups)]
    for i, (start, _, one, gap) in enumerate(groups):
        near = before + gap if i == 0 else groups[i - 1][2] + gap
        for n in range(1, min(MOST_GROUPS, len(groups) - i) + 1):
            part = groups[i : i + n]
            number = "".join(g[2] for g in part)
            if not all(joins[i + 1 : i + n]) or len(number) > MOST_DIGITS:
                break
            if len(number) < LEAST_DIGITS:
                continue
            signs = "".join(g[3] for g in part[1:])
            rest = groups[i + n][3] if i + n < len(groups) else region[part[-1][1] : part[-1][1] + 3]
            add(start, part[-1][1], near, {
                "digits": len(number), "groups": n, "first": len(one), "last": len(part[-1][2]), "most": max(len(g[2]) for g in part),
                "hyphens": signs.count("-"), "dots": signs.count("."), "spaces": signs.count(" "),
                "bracket": _flag(BRACKET, near[-CONTEXT:] + signs), "plus": _flag(PLUS, near),
                "luhn": int(13 <= len(number) and passes_luhn(number)), "zero": int(number[0] == "0"),
                "year": int(len(one) == 4 and one[:2] in ("19", "20")), "inner": int(joins[i]),
                "more": int(i + n < len(groups) and joins[i + n]), "tail": _flag(TAIL, rest),
            })
    for pattern in (TOKEN, SPELLED):
        at = 0
        for m in re.finditer(pattern, region):
            gap, at, first = region[at : m.start()], m.end(), at == 0
            near, text = before + gap if first else gap, m[0]
            if pattern is SPELLED:
                add(m.start(), m.end(), near, {
                    "spelled": 1, "bracket": int("(" in text), "length": min(99, len(text)), "first": min(99, len(re.match("[^ (]*", text)[0])),
                    "last": min(99, len(re.search("[A-Za-z0-9-]*$", text)[0])), "stop": _flag(STOP, text.translate(_SMALL)),
                })
            elif len(text) >= LEAST_TOKEN and re.search("[0-9]", text):
                add(m.start(), m.end(), near, {
                    "token": 1, "length": min(99, len(text)), "numbers": min(99, len(re.sub("[^0-9]", "", text))),
                    "hex": int(bool(re.match("([0-9a-f]+|[0-9A-F]+)$", text))), "turns": min(99, len(re.findall("[0-9]+", text))),
                    "hyphens": text.count("-"), "mixed": _flag("[a-z]", text) + _flag("[A-Z]", text),
                    "prefix": _flag(PREFIX, text),
                })
    return out


def row_of(known: dict[str, int]) -> list[int]:
    return [known.get(name, 0) for name in FEATURES]


def _filled(rng: random.Random, shape: str) -> str:
    """A shape's signs replaced: 9 a digit, 8 a digit but zero, h a hex digit, b a letter or digit, B a capital or digit."""
    sets = {"9": "0123456789", "8": "123456789", "h": "0123456789abcdef", "b": LOWER + UPPER + "0123456789", "B": UPPER + "0123456789"}
    return "".join(rng.choice(sets[c]) if c in sets else c for c in shape)


def _card(rng: random.Random, shape: str) -> str:
    """A number of this shape that passes the check."""
    while not passes_luhn(re.sub("[^0-9]", "", text := _filled(rng, shape))):
        pass
    return text


#: By kind: words before, and shapes. Every third shape and word is kept for calibration.
CALLS = ["call ", "call me at ", "phone: ", "tel. ", "tel: ", "mobile ", "fax: ", "ring ", "whatsapp ", "my cell ", "telefon ", "dial ", "hotline: ", "phone number is "]
PERSONS = ["ssn ", "ssn: ", "social security number ", "passport ", "account ", "acct. ", "my tax id is ", "insurance no ", "konto ", "account number: "]
PAYS = ["card ", "credit card ", "visa ", "paid with card number ", "karte ", "carte ", "amex ", "mastercard: "]
HIDES = ['token = "', "secret: ", "api_key=", "password ", "bearer ", 'key: "', "auth ", "token: ", "credential ", 'password = "']
WRITES = ["mail ", "write to ", "contact ", "reach me: ", "e-mail: ", "correo ", "email me at "]
GOODS = ["order ", "invoice no ", "isbn ", "version ", "pages ", "part ", "serial ", "model ", "item ", "sku ", "commit ", "sha ", "md5 ", "rev ", "ticket ", "file ", "doi ", "uuid "]
PLAIN = ["the ", "and of ", "was, ", "er ", "or ", "in ", "la ", "und ", "des ", "at once ", "then, "]
SHAPES = {
    "telephone": ["899-899-9999", "(899) 899-9999", "899.899.9999", "0899 9999999", "099 9999 9999", "08 99 99 99 99", "0899-999999", "899 899 9999", "(0899) 999999", "+99 899 9999999", "00899 999 99999", "1-899-899-9999"],
    "payment": ["4999 9999 9999 9999", "4999999999999999", "5999-9999-9999-9999", "3999 999999 99999", "5999999999999999", "6999 9999 9999 9999"],
    "identity": ["899-99-9999", "899999999", "8999999", "89999999", "899 99 9999", "8999999999", "899-999-999"],
    "secret": ["h" * 40, "h" * 32, "b" * 32, "b" * 24, "sk-" + "b" * 32, "ghp_" + "b" * 36, "AKIA" + "B" * 16, "h" * 64, "B" * 20],
    "mail": ["{a} at {b} dot com", "{a} (at) {b} (dot) org", "{a}(at){b}.com", "{a}.{b} (at) {b}.net", "{a} AT {b} DOT com", "{a}99 (at) {b}.de"],
}
#: Of these kinds a shape alone is enough, whatever stands before.
ALONE = {
    "telephone": {"(899) 899-9999", "899-899-9999", "899.899.9999", "+99 899 9999999", "0899 9999999", "(0899) 999999"},
    "payment": set(SHAPES["payment"]), "identity": {"899-99-9999"}, "secret": {"sk-" + "b" * 32, "ghp_" + "b" * 36, "AKIA" + "B" * 16},
    "mail": {"{a} (at) {b} (dot) org", "{a}(at){b}.com", "{a}.{b} (at) {b}.net", "{a}99 (at) {b}.de", "{a} at {b} dot com"},
}
NOISE = [
    "9999999999999999", "2099-09-19 99:99", "1999-2099", "978-9-99-999999-9", "99 999 9 99 9999 9", "99999999999999999999999", "1.999.999", "99.999999 99.999999",
    "AB-9999999", "2099.99.99", "9 9 9 9 9 9 9 9 9", "999,999,999", "h" * 40, "h" * 12 + "-hhhh-hhhh", "release_2099-99-99_build", "some-long-identifier-9", "https://x.org/a/99999999", "99-99-9999 99",
    "v9.99.9999", "{a} at {b} dot matrix", "arrived at {b} dot", "was at the dot line", "9999 9999", "999-9999", "b" * 24, "8999999", "899999999",
]


def training_lines(count: int, seed: int, part: int | None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines with their planted spans; ``part`` 0 uses every third shape and word, 1 the others, None all."""
    rng = random.Random(seed)
    some = lambda items: [x for i, x in enumerate(items) if part is None or (i % 3 == 0) == (part == 0)]
    before = {"telephone": some(CALLS), "payment": some(PAYS), "identity": some(PERSONS), "secret": some(HIDES), "mail": some(WRITES)}
    goods, plain = some(GOODS), some(PLAIN)
    names = ["anna", "b.koch", "jdoe", "m_lopez", "info"]
    lines = []

    def word() -> str:
        return "".join(rng.choice(LOWER) for _ in range(rng.randint(2, 9)))

    def made(shape: str, kind: str | None) -> str:
        if "{" in shape:
            return shape.format(a=rng.choice(names), b=word())
        return _card(rng, shape) if kind == "payment" else _filled(rng, shape)

    for _ in range(count):
        text, spans = rng.choice(["", word() + " ", f"{word()}, {word()} "]), []
        for _ in range(rng.choice([1, 1, 1, 2])):
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                shape = rng.choice(some(SHAPES[kind]))
                free = shape in ALONE[kind] and rng.random() < 0.5
                text += rng.choice(plain + [""]) if free else rng.choice(before[kind])
                span = made(shape, kind)
                start = len(text) + span.startswith("+") + span.startswith("(") * (kind == "telephone")
                text += span
                spans.append((start, len(text), kind))
            else:
                text += rng.choice(goods if rng.random() < 0.6 else plain) + made(rng.choice(NOISE), None)
            text += rng.choice([" ", " ", ", ", ". ", '" ', "; "]) + rng.choice(["", word() + " "])
        lines.append((text + word(), spans))
    return lines


def examples(lines: list) -> tuple[np.ndarray, np.ndarray]:
    """Features and kind numbers (-1: none) of the lines' candidates."""
    rows, kinds = [], []
    for text, spans in lines:
        planted = {(a, b): KINDS.index(kind) for a, b, kind in spans}
        at = 0
        for m in re.finditer(REGION, text):
            before, at = text[at : m.start()][-CONTEXT:], m.end()
            for start, end, known in plain_candidates(m[0], before):
                rows.append(row_of(known))
                kinds.append(planted.get((m.start() + start, m.start() + end), -1))
    return np.array(rows, dtype=np.int64), np.array(kinds)


def _grow(rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, threshold, low, high) or a leaf value."""
    g, h = gradient.sum(), hessian.sum()
    leaf = round(float(0.4 * g / (h + 1.0)), 6)
    if not depth or not len(rows):
        return leaf
    best = (1e-6, None)
    for feature in range(rows.shape[1]):
        gl = np.cumsum(np.bincount(rows[:, feature], gradient))[:-1]
        hl = np.cumsum(np.bincount(rows[:, feature], hessian))[:-1]
        if len(gl):
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), (feature, at))
    if best[1] is None:
        return leaf
    feature, value = best[1]
    low = rows[:, feature] <= value
    return (feature, value, _grow(rows[low], gradient[low], hessian[low], depth - 1), _grow(rows[~low], gradient[~low], hessian[~low], depth - 1))


def _predict(tree, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    return np.where(rows[:, tree[0]] <= tree[1], _predict(tree[2], rows), _predict(tree[3], rows))


@lru_cache
def model(count: int = 2_500, rounds: int = 12, depth: int = 4, precision: float = 0.97) -> dict[str, tuple[tuple, float]]:
    """By kind: trees, and the threshold on their sum.

    Thresholds are calibrated on lines of shapes and words that training didn't
    see: the lowest at which ``precision`` of the accepted candidates are planted
    spans, but never below even odds.
    """
    rows, kinds = examples(training_lines(count, 5, 1))
    seen, truth = examples(training_lines(count // 2, 6, 0))
    out = {}
    for number, kind in enumerate(KINDS):
        y = (kinds == number).astype(float)
        total, trees = np.zeros(len(rows)), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            trees.append(_grow(rows, y - p, p * (1 - p), depth))
            total += _predict(trees[-1], rows)
        scores = sum(_predict(t, seen) for t in trees)
        order = np.argsort(-scores, kind="stable")
        share = np.cumsum(truth[order] == number) / np.arange(1, len(order) + 1)
        last = np.append(scores[order][1:] != scores[order][:-1], True) & (share >= precision)
        lowest = float(scores[order][np.flatnonzero(last)[-1]]) if last.any() else float("inf")
        highest = float(scores.max()) + 1
        out[kind] = (tuple(trees), round(max(0.0, min(lowest, highest)) - 1e-4, 4))
    return out


def plain_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by definition, base ones and added ones, in no order."""
    text, out, at = text or "", [], 0
    for m in re.finditer(REGION, text):
        before, at, region, start = text[at : m.start()][-CONTEXT:], m.end(), m[0], m.start()
        base = []
        for kind, pattern in BASE.items():
            for x in re.finditer(pattern, region):
                digits = re.sub("[^0-9]", "", x[0])
                ok = {
                    "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and passes_luhn(digits), "phone": 9 <= len(digits) <= 15,
                }[kind]
                base += [(kind, x.start(), x.end())] if ok else []
        chosen = []
        for a, b, known in plain_candidates(region, before):
            if any(s <= a and e >= b for _, s, e in base):
                continue
            row = np.array([row_of(known)])
            score, _, kind = max((float(_sum(trees, threshold, row)), -i, kind) for i, (kind, (trees, threshold)) in enumerate(model().items()))
            chosen += [(a, b, score, kind)] if score > 0 else []
        now = None
        for a, b, score, kind in sorted(chosen):
            if now and a < now[2]:
                now = [kind if score > now[3] else now[0], now[1], max(now[2], b), max(now[3], score)]
            else:
                base += [tuple(now[:3])] if now else []
                now = [kind, a, b, score]
        base += [tuple(now[:3])] if now else []
        out += [(kind, a + start, b + start) for kind, a, b in base]
    return out


def _sum(trees: tuple, threshold: float, rows: np.ndarray) -> float:
    total = -threshold
    for tree in trees:
        total = total + _predict(tree, rows)[0]
    return total
