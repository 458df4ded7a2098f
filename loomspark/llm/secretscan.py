"""Operator 8: secret scans by base patterns and grammar inference.

Three base patterns (assign, access, hex) are found exactly as stated. Automata for credential formats are inferred from
labelled credentials: a prefix tree of their symbols (a leading word or two with their separators as one symbol, then every character
by class) whose statistically compatible states are merged (ALERGIA, Hoeffding bound), wherever in the tree they stand. A second
automaton is inferred likewise from ordinary long tokens. Tokens of `SHORTEST` characters or more are scored by their likelihood
under the first against the second, from every place in a run of token characters where a letter or digit follows none. Tokens that
score above every ordinary one of the training set are added as spans of kind `grammar`: up to the last end that the automaton
reaches if that scores enough, else up to the end of the best sum. As no character is known by itself, formats that no label showed
are found too. Base spans always stay, whatever their score, and an added span never overlaps one; `score` tells the best score of a
text's spans.

Defined results: a null or empty text has no spans; repeated rows are scanned once each; a null doc_id is passed on; an empty
table gives no rows; further columns are ignored; a text without spans has a null score.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

KINDS = ("assign", "access", "hex")
_ORDER = (*KINDS, "grammar")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
_START = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]")
_END = re.compile(r"(?<![.=-])(?![A-Za-z0-9])")
_WORDS = ("passw", "secret", "token", "api")
SHORTEST, BODY = 20, 16
#: A leading word or more with their separators, such as "ghp_" or "sk_live_": one symbol if a body follows.
_LEAD = re.compile(r"[A-Za-z]{2,8}(?:[_-][A-Za-z]{2,6})*[_-]|[A-Z]{2}\.")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def kind(c: str) -> str:
    return "9" if c.isdigit() else "h" if c in "abcdef" else "a" if c.islower() else "H" if c in "ABCDEF" else "A" if c.isupper() else c


def lead(text: str, a: int, hi: int) -> int:
    """Where the body begins, behind a leading word if that leaves one."""
    m = _LEAD.match(text, a, hi)
    return m.end() if m and hi - m.end() >= BODY else a


def symbols(token: str) -> list[str]:
    """The leading words as one symbol, then classes: hexadecimal letters apart from other letters."""
    at = lead(token, 0, len(token))
    return (["^"] if at else []) + [kind(c) for c in token[at:]]


class Automaton:
    """A probabilistic deterministic automaton with counts: state -> symbol -> (state, count), and how many strings end there."""

    def __init__(self, strings: list[list[str]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self._merge_all(alpha)

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _compatible(self, a: int, b: int, alpha: float, depth: int = 0) -> bool:
        na, nb = self._total(a), self._total(b)
        if not na or not nb:
            return True
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
            return False
        for c in {*self.count[a], *self.count[b]}:
            if abs(self.count[a][c] / na - self.count[b][c] / nb) > bound:
                return False
        if depth < 40:
            for c in self.next[a].keys() & self.next[b].keys():
                x, y = self.next[a][c], self.next[b][c]
                if x != y and not self._compatible(x, y, alpha, depth + 1):
                    return False
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        self.ends[a] += self.ends[b]
        for c, to in list(self.next[b].items()):
            self.count[a][c] += self.count[b][c]
            if c in self.next[a]:
                if self.next[a][c] != to:
                    self._fold(self.next[a][c], to)
            else:
                self.next[a][c] = to

    def _merge_all(self, alpha: float) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            home = next((r for r in red if self._compatible(r, q, alpha)), None)
            if home is None:
                red.append(q)
                blue += [(q, s) for s in sorted(self.next[q])]
            else:
                self.next[p][c] = home
                self._fold(home, q)
                blue += [(home, s) for s in sorted(self.next[home]) if self.next[home][s] not in red and (home, s) not in blue]

        self._keep_reachable()

    def _keep_reachable(self) -> None:
        seen, new = [0], {0: 0}
        for q in seen:
            for c in sorted(self.next[q]):
                to = self.next[q][c]
                if to not in new:
                    new[to] = len(seen)
                    seen.append(to)
        self.next = [{c: new[to] for c, to in self.next[q].items()} for q in seen]
        self.count, self.ends = [self.count[q] for q in seen], [self.ends[q] for q in seen]


def labelled(seed: int = 11, each: int = 120) -> tuple[list[str], list[str]]:
    """Credentials of public formats, and ordinary long tokens."""
    r = random.Random(seed)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = low + up + dig
    makers = [
        lambda: "AKIA" + some(up + "234567", 16), lambda: "ghp_" + some(every, 36), lambda: "sk_live_" + some(every, 24),
        lambda: "xoxb-" + some(dig, 11) + "-" + some(every, 24), lambda: "AIza" + some(every + "-_", 35), lambda: "glpat-" + some(every, 20),
        lambda: "SG." + some(every, 22) + "." + some(every, 43), lambda: "eyJhbGciOi" + some(every, 26) + "." + some(every, 40) + "." + some(every, 43),
    ]
    word = lambda: some("aeioustrnlmdh", r.randint(3, 9))
    # Words of any length in lower case, upper case, capitals or compounds.
    short = lambda: some("aeioustrnlmdh", r.randint(1, 9))
    styled = lambda: r.choice([short, short, lambda: short().upper(), lambda: short().capitalize(), lambda: short() + short().capitalize() + short().capitalize()])()
    plain = [
        lambda: "-".join(word() for _ in range(5)) + some(dig, 2), lambda: "/" + "/".join(word() for _ in range(4)) + "/" + some(dig, 4), lambda: word() + "." + word() + "." + word() + some(dig, 4) + word(),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + some(dig, 3), lambda: word() + word() + word() + word() + some(dig, 1), lambda: some(dig, 22) + some(low, 1),
        lambda: "".join(word().capitalize() for _ in range(4)) + some(dig, 2), lambda: some(dig, 4) + "-" + some(dig, 2) + "-" + some(dig, 2) + "T" + some(dig, 2) + some(dig, 10),
        lambda: "-".join(styled() for _ in range(5)), lambda: "/".join(styled() for _ in range(5)), lambda: "_".join(styled() for _ in range(4)) + ".py",
    ]
    return [m() for m in makers for _ in range(each)], [x for m in plain for _ in range(each) if len(x := m()) >= 20]


class Grammar:
    def __init__(self, positive: list[str], negative: list[str]):
        self.formats, self.plain = Automaton([symbols(x) for x in positive]), Automaton([symbols(x) for x in negative])
        self.limit = 0.0
        self.steps: dict[tuple, tuple] = {}
        good, bad = sorted(map(self.score, positive)), sorted(map(self.score, negative))
        # Half-way between the best ordinary token and all but the last fiftieth of the labelled credentials.
        self.limit = max(bad[-1] + 0.05, (bad[-1] + good[len(good) // 50]) / 2)
        self.steps = {}

    def score(self, token: str) -> float:
        """Log likelihood per symbol under the formats, less that under ordinary tokens."""
        q, total, s = (0, 0), 0.0, symbols(token)
        for c in s:
            q, more = self._step(q, c)
            total += more + self.limit
        return total / max(1, len(s))

    def _step(self, q: tuple, c: str) -> tuple[tuple, float]:
        """The next states of both automata, and by how much the symbol's score exceeds the limit."""
        if (q, c) not in self.steps:
            to, odds = [], []
            for a, at in zip((self.formats, self.plain), q, strict=True):
                n, seen = (0, 0) if at is None else (a._total(at), a.count[at][c])
                to.append(None if at is None else a.next[at].get(c))
                odds.append(math.log((seen + 0.02) / (n + 2.0)) if at is not None else -4.0)
            self.steps[q, c] = (tuple(to), odds[0] - odds[1] - self.limit)
        return self.steps[q, c]

    def spans(self, text: str, lo: int, hi: int) -> list[tuple[int, int, float]]:
        """Tokens within text[lo:hi], a part of one run, whose score reaches the limit, with it.

        What follows a place in a state does not depend on where the token began, so it is worked out once: time is linear in the run.
        """
        out, known, at = [], {}, lo
        for m in _START.finditer(text, lo, hi):
            a = m.start()
            if a < at or hi - a < SHORTEST:
                continue
            body = lead(text, a, hi)
            q, head = self._step((0, 0), "^") if body > a else ((0, 0), 0.0)
            first = max(body + BODY, a + SHORTEST)
            for p in range(body, first):
                q, more = self._step(q, kind(text[p]))
                head += more
                if q[0] is None:
                    break
            else:
                reached, r, best, b = self._rest(text, first, hi, q, known)
                end, total = (reached, head + r) if head + r >= 0 else (best, head + b) if head + b >= 0 else (at, 0.0)
                if end > a:
                    at = end
                    out.append((a, at, total / (at - body + (body > a)) + self.limit))
        return out

    def _rest(self, text: str, p: int, hi: int, q: tuple, known: dict) -> tuple[int, float, int, float]:
        """From a place and state on: the last end that the automaton reaches and the excess up to it, the end of the most excess and that."""
        path = []
        while (p, q) not in known:
            path.append((p, q))
            if p == hi:
                break
            to, more = self._step(q, kind(text[p]))
            path[-1] += (more,)
            p, q = p + 1, to
        found = known.get((p, q), (0, -math.inf, 0, -math.inf))
        for p, q, *more in reversed(path):
            reached, r, best, b = found
            if more:
                r, b = r + more[0], b + more[0]
            if _END.match(text, p):
                if not reached and q[0] is not None:
                    reached, r = p, 0.0
                if b < 0:
                    best, b = p, 0.0
            found = known[p, q] = (reached, r, best, b)
        return found


@functools.cache
def fitted() -> Grammar:
    return Grammar(*labelled())


def scored(text: str | None, grammar: Grammar) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float | None]:
    """Base spans and added spans of a whole text, and the best score of any of them."""
    if not text:
        return [], [], None
    base, more = base_spans(text), []
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        starts.append(a)
        ends.append(max(b, ends[-1] if ends else b))
    for m in _RUN.finditer(text):
        lo, i = m.start(), bisect.bisect_right(ends, m.start())
        while i < len(starts) and starts[i] < m.end():
            more += grammar.spans(text, lo, starts[i])
            lo, i = max(lo, ends[i]), i + 1
        more += grammar.spans(text, lo, m.end())
    best = max([x[2] for x in more] + [grammar.score(text[a:b]) for _, a, b in base], default=None)
    return base, [("grammar", a, b) for a, b, _ in more], best


def find(text: str | None, grammar: Grammar) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans of a whole text."""
    return scored(text, grammar)[:2]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _ORDER.index(s[0]), s[2])))


def _scan(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scored(t, grammar) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in found]
            spans = [_joined(base + more) for base, more, _ in found]
            best = [x for _, _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(best, pa.float64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "score"])

    return run


def secrets(documents: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """Per row of documents (doc_id, text): counts of base spans, their digest, and all spans."""
    return documents.select("doc_id", "text").mapInArrow(_scan(grammar or fitted()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, score double")


def redact(text: str | None, grammar: Grammar, mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced by a mark."""
    spans = sorted((a, b) for found in find(text, grammar) for _, a, b in found)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redacted(text: Column, grammar: Grammar | None = None) -> Column:
    grammar = grammar or fitted()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([redact(t, grammar) for t in column.to_pylist()], pa.string())

    return run(text)


def op8_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
