"""Operator 6: personal data by base patterns and a semi-Markov conditional random field.

Four base patterns (email, ip, card, phone) are found exactly as stated, in time linear in the text. Around anything that
looks like part of an entity the field then scores whole spans of one to `SHORT` tokens (numbers and masked addresses of any) by features of the span
and its neighbours, and bounded-entity dynamic programming picks boundaries and kinds together. It adds
spans that the patterns do not state, such as national telephone numbers after a cue, masked addresses, or a telephone and a card number
that stand side by side and that a pattern took for one too long match; base spans always stay, and an added span never overlaps one.

The field is fitted here, by gradient ascent on the likelihood of generated sentences with known spans, among them many
numbers that are no personal data. A fit is a pure function of its seed.

Defined results: a null or empty text has no spans; repeated rows are scanned once each; a null doc_id is passed on; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import table

KINDS = ("email", "ip", "card", "phone")
SHORT = 5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs cost no more than their length."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_TOKEN = re.compile(r"\S+")
_SEED = re.compile(r"[0-9][0-9 ().\-/]{5,}[0-9]|@|[(\[{<] ?at ?[)\]}>]")
_CUES = {
    "phone": frozenset("phone tel telephone mobile cell fax call whatsapp sms hotline telefon handy anruf téléphone teléfono móvil".split()),
    "card": frozenset("card visa mastercard amex credit debit kreditkarte carte tarjeta".split()),
    "ip": frozenset("ip address host server adresse".split()),
    "email": frozenset("email e-mail mail contact write kontakt courriel correo".split()),
}
_AT = re.compile(r"(?i)^[a-z0-9._%+-]+ ?(?:@|[(\[{<] ?at ?[)\]}>]) ?[a-z0-9-]+(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]) ?[a-z0-9-]+)+$")
_NATIONAL = re.compile(r"^(?:\(0?[0-9]{2,5}\)[ -]?|0[0-9]{1,4}[ /-])?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}$")
_INTERNATIONAL = re.compile(r"^\+[0-9][\x20().0-9-]+[0-9]$")
_TRIM = " .,;:!?\"'"
# A masked address from its local part on, and how one goes on behind a label or the sign: longer ones than SHORT words are found by these.
_DOT = r"(?:\.|\s*[(\[{<]\s?dot\s?[)\]}>]\s*)"
_MASKED = re.compile(rf"(?i)[a-z0-9._%+-]++\s*(?:@|[(\[{{<]\s?at\s?[)\]}}>])\s*[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+")
_DOMAIN_ON = re.compile(rf"(?i)\s*[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*")
_GOES_ON = re.compile(r"(?i)\s*[(\[{<]\s?dot\s?[)\]}>]\s*[a-z0-9-]")
_NUMBER_WORD = re.compile(r"[0-9+().,;:!?\"'/-]+")
MOST_DIGITS = 19


def span_features(text: str, before: str) -> list[str]:
    """Features of a whole span, its text trimmed, and of the word before it."""
    d, cue = _digits(text), before.strip(_TRIM + "()#").lower()
    out = [f"words{min(text.count(' ') + 1, 4)}", f"digits{min(len(d), 20) if d else 0}", "at" if _AT.match(text) else "no-at"]
    out.append("letters" if any(c.isalpha() for c in text) else "numeric")
    if d and not any(c.isalpha() for c in text):
        if _NATIONAL.match(text) and 9 <= len(d) <= 12 and (" " in text or "-" in text or "(" in text or "/" in text or "." in text):
            out.append("national")
        if _INTERNATIONAL.match(text) and 9 <= len(d) <= 15:
            out.append("international")
        out.append("luhn" if 13 <= len(d) <= 19 and luhn(d) else "no-luhn")
        parts = text.split(".")
        out.append("quad" if len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts) else "no-quad")
    out += [f"cue-{k}" for k, words in _CUES.items() if cue in words] or ["no-cue"]
    out += [f"{a}&{b}" for a in out if a in ("national", "international", "at", "luhn", "quad") for b in out if b.startswith(("cue", "no-cue"))]
    return out


class Field:
    """Weights of span features by kind. Words outside entities score 0."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def score(self, kind: str, features: list[str]) -> float:
        w = self.weights
        return w.get((kind, "bias"), 0.0) + sum(w.get((kind, f), 0.0) for f in features)

    @staticmethod
    def spans(text: str, tokens: list[tuple[int, int]], taken: Callable[[int, int], bool] = lambda a, b: False) -> list[list[tuple[int, int, int, list[str]]]]:
        """For each end j the candidate spans: first token, start, end, features. Words without a digit or sign make none, nor does what is taken.

        Of more than SHORT words are numbers (of no more digits than any kind has) and masked addresses, however many words these have.
        """
        out: list[list[tuple[int, int, int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        longer: list[list[int]] = [[] for _ in range(len(tokens) + 1)]
        ends = [b for _, b in tokens]
        numbers: list[tuple[int, int]] = []  # words with digits of the present run of numbers, and how many digits each has
        first = 0
        for j, (a, b) in enumerate(tokens, 1):
            if m := _MASKED.match(text, a):
                k = bisect.bisect_left(ends, m.end()) + 1
                if k <= len(tokens) and k - j >= SHORT and not text[m.end() : ends[k - 1]].strip(_TRIM):
                    longer[k].append(j - 1)
            if not _NUMBER_WORD.fullmatch(text, a, b):
                numbers, first = [], j
            elif d := len(_digits(text[a:b])):
                numbers.append((j - 1, d))
                left = MOST_DIGITS
                for i, d in reversed(numbers):
                    left -= d
                    if left < 0:
                        break
                    # A sign or bracket may stand by itself before the digits.
                    longer[j] += [x for x in (i, i - 1) if x >= first and j - x > SHORT]
        for j in range(1, len(tokens) + 1):
            for i in sorted({*longer[j], *range(max(0, j - SHORT), j)}):
                a, b = tokens[i][0], tokens[j - 1][1]
                while a < b and text[a] in _TRIM:
                    a += 1
                while b > a and text[b - 1] in _TRIM:
                    b -= 1
                part = text[a:b]
                if b > a and not taken(a, b) and (_DIGIT.search(part) or "@" in part or _AT.match(part)):
                    words = " ".join(part.split())
                    if _AT.match(words) and _GOES_ON.match(text, b):
                        continue
                    before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
                    out[j].append((i, a, b, span_features(words, before)))
        return out

    def decode(self, text: str, tokens: list[tuple[int, int]], taken: Callable[[int, int], bool] = lambda a, b: False, margin: float = 1.0) -> list[tuple[str, int, int]]:
        """The best segmentation around what is taken; spans that gain less than margin over no entity are left out."""
        best: list[float] = [0.0] * (len(tokens) + 1)
        back: list[tuple | None] = [None] * (len(tokens) + 1)
        for j, spans in enumerate(self.spans(text, tokens, taken)):
            if not j:
                continue
            best[j] = best[j - 1]
            for i, a, b, features in spans:
                for kind in KINDS:
                    s = self.score(kind, features) - margin
                    if s > 0 and best[i] + s > best[j]:
                        best[j], back[j] = best[i] + s, (i, kind, a, b)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind, a, b = back[j]
                out.append((kind, a, b))
                j = i
        return out[::-1]

    def gradient(self, text: str, tokens: list[tuple[int, int]], gold: set[tuple[str, int, int]]) -> dict[tuple[str, str], float]:
        """Of the log likelihood, by the forward-backward sums over all segmentations."""
        n, spans = len(tokens), self.spans(text, tokens)
        forward = np.full(n + 1, -np.inf)
        forward[0] = 0.0
        scored = [[(i, a, b, f, [self.score(k, f) for k in KINDS]) for i, a, b, f in s] for s in spans]
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for i, _, _, _, ss in scored[j] for s in ss)])
        backward = np.full(n + 1, -np.inf)
        backward[n] = 0.0
        for j in range(n, 0, -1):
            backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
            for i, _, _, _, ss in scored[j]:
                backward[i] = np.logaddexp.reduce([backward[i], *(backward[j] + s for s in ss)])
        out: dict[tuple[str, str], float] = {}
        for j in range(1, n + 1):
            for i, a, b, features, ss in scored[j]:
                for kind, s in zip(KINDS, ss, strict=True):
                    p = math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                    d = ((kind, a, b) in gold) - p
                    if abs(d) > 1e-4:
                        for f in ["bias", *features]:
                            out[kind, f] = out.get((kind, f), 0.0) + d
        return out


def _sentence(r: random.Random) -> tuple[str, set[tuple[str, int, int]]]:
    """A generated sentence and its spans."""
    word = lambda: "".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    text, gold = "", set()

    def add(s: str, kind: str | None = None) -> None:
        nonlocal text
        text += " " if text else ""
        if kind:
            gold.add((kind, len(text), len(text) + len(s)))
        text += s

    for _ in range(r.randint(1, 4)):
        add(word())
    pick = r.randrange(16)
    if pick == 0:
        add(f"{word()}.{num(2)}@{word()}.com", "email")
    elif pick == 1:
        add(r.choice([f"{word()} (at) {word()} (dot) com", f"{word()} [at] {word()}.org", f"{word()}(at){word()}.net"]), "email")
    elif pick == 2:
        add(".".join(str(r.randrange(256)) for _ in range(4)), "ip")
    elif pick == 3:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        add(d if r.random() < 0.5 else " ".join(d[i : i + 4] for i in range(0, 16, 4)), "card")
    elif pick == 4:
        add(r.choice([f"+{r.randint(1, 49)} {num(3)} {num(3)} {num(4)}", f"+{r.randint(1, 49)} ({num(3)}) {num(3)}-{num(4)}", f"+{r.randint(1, 49)}{num(9)}", f"+{r.randint(1, 49)}-{num(3)}-{num(7)}"]), "phone")
    elif pick in (5, 6):
        add(r.choice(sorted(_CUES["phone"])) + r.choice(["", ":"]))
        add(r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}/{num(7)}"]), "phone")
    elif pick == 7:
        add(f"{num(3)}-{num(3)}-{num(4)}")  # without a cue: an order number as well as a telephone
    elif pick == 8:
        add(num(r.randint(5, 18)))
    elif pick == 9:
        add(f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}")
    elif pick == 10:
        add(" ".join(num(r.randint(1, 5)) for _ in range(r.randint(2, 5))))
    elif pick == 11:
        add(f"{num(2)}.{num(1)}.{num(2)}")
    elif pick == 12:
        add(f"{num(4)} {num(4)} {num(4)} {num(3)}")
    elif pick == 13:
        add(f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}")
    elif pick == 14:
        add(f"{num(3)}.{num(3)},{num(2)}")
    else:
        add(f"@{word()}")
    for _ in range(r.randint(0, 3)):
        add(word())
    return text + r.choice(["", "."]), gold


@functools.cache
def fitted(seed: int = 5, sentences: int = 600, rounds: int = 4) -> Field:
    r = random.Random(seed)
    data = [_sentence(r) for _ in range(sentences)]
    field = Field({})
    for t in range(rounds):
        for text, gold in data:
            for key, d in field.gradient(text, [m.span() for m in _TOKEN.finditer(text)], gold).items():
                field.weights[key] = field.weights.get(key, 0.0) * (1 - 1e-4) + 0.3 / (1 + t) * d
    return field


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans that the field finds and that overlap no base span."""
    out, stop = [], 0
    # Base spans of different kinds may overlap; their union is what is taken.
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def taken(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b) - 1
        return i >= 0 and ends[i] > a

    def covered(a: int, b: int) -> bool:
        i = bisect.bisect_right(starts, a) - 1
        return i >= 0 and ends[i] >= b

    for seed in _SEED.finditer(text):
        if seed.start() < stop or covered(*seed.span()):
            continue
        # Three words to either side, but no word of more than 200 characters.
        lo = max(stop, seed.start() - 200)
        left = [m.span() for m in _TOKEN.finditer(text, lo, seed.start())][-4:]
        on = None if text[seed.end() - 1].isdigit() else _DOMAIN_ON.match(text, seed.end())
        reach = on.end() if on else seed.end()
        hi = min(len(text), reach + 200)
        tokens = [m.span() for m in _TOKEN.finditer(text, left[0][0] if left else seed.start(), hi)]
        end = next((k for k, s in enumerate(tokens) if s[0] >= reach), len(tokens))
        tokens = tokens[: end + 3]
        found = field.decode(text, tokens, taken)
        out += found
        stop = max([seed.end(), *(s[2] for s in found)])
    return list(dict.fromkeys(out))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans of a whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, field)


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t, field) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            spans = [_joined(base + more) for base, more in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of documents (doc_id, text): counts of base spans, their digest, and all spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return documents.select("doc_id", "text").mapInArrow(_scan(field or fitted()), schema)


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
