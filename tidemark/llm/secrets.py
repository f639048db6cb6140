"""Secret scans: fixed patterns, and formats that are learned from what they match.

The values that the patterns match are labelled credentials. From a bounded sample of distinct ones a prefix tree is built for each kind
and its states are merged where their futures are statistically compatible: first states of one depth, whose counts are thin until they are
together, then states of different depths (ALERGIA). Lengths, prefixes and alphabets that the values have in common stay apart, and what is left
is a probabilistic automaton of the formats. It scores every run of credential characters of every text against ordinary strings, whose
pairs of characters are counted over all texts; candidates above a threshold that labelled values reach are secrets too.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log, log2, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, texts

#: The kinds with their patterns, in the order in which they are listed (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
#: What an automaton scores: whole runs of the characters of credentials, and where a run isn't one, its parts of letters and digits. Labelled values have 12 characters too.
LEAST = 12
CANDIDATE, PART = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"), re.compile(rf"[A-Za-z0-9]{{{LEAST},}}")
#: The sample of labelled values that automata are inferred from: so many of each kind, the first by hash, among those of at most so many characters.
SAMPLE, LONGEST = 3000, 128
#: Confidence of the test that keeps states apart, the share of labelled values kept back that may be below the threshold's double, and bits for each character that the threshold has at least.
ALPHA, MISSED, LEAST_BITS = 0.05, 0.02, 1.0
#: Classes of characters that credentials are made of: what isn't seen in one state or behind one character has the odds of its class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-.")
CLASS_OF = {c: k for k, cs in enumerate(CLASSES) for c in cs}
#: Weight of a class's odds, in observations, and its share however many there are.
BACK, RARE = 4.0, 0.05


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, code points, end exclusive; leftmost without overlaps within a kind.

    Matches that are too short are dropped, and what they cover is still consumed: for maximal runs (access, hex) that is the same as
    asking for the length at once.
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    return [ASSIGN.match(text, a, b).group(2) if k == 0 else text[a:b] for a, b, k in spans]


class Automaton:
    """A probabilistic automaton: state -> character -> state, with the number of strings that went there, and how many end in each state."""

    def __init__(self, counts: Counter[str], alpha: float = ALPHA):
        self.next: list[dict[str, list[int]]] = [{}]
        self.end: list[int] = [0]
        for value, n in sorted(counts.items()):
            state = 0
            for c in value:
                step = self.next[state].get(c)
                if step is None:
                    step = self.next[state][c] = [len(self.next), 0]
                    self.next.append({})
                    self.end.append(0)
                step[1] += n
                state = step[0]
            self.end[state] += n
        self.alpha = sqrt(0.5 * log(2 / alpha))
        self.same = list(range(len(self.next)))  # what a state was merged into
        self.merge_depths()
        self.merge_across()
        self.known: list[dict[str, tuple[float, int]]] = [{} for _ in self.next]

    def find(self, state: int) -> int:
        while self.same[state] != state:
            self.same[state] = self.same[self.same[state]]
            state = self.same[state]
        return state

    def seen(self, state: int) -> int:
        return self.end[state] + sum(n for _, n in self.next[state].values())

    def compatible(self, p: int, q: int) -> bool:
        """No Hoeffding bound tells the two futures apart, at any depth."""
        todo, met = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in met:
                continue
            met.add((p, q))
            n, m = self.seen(p), self.seen(q)
            if not n or not m or (bound := self.alpha * (1 / sqrt(n) + 1 / sqrt(m))) >= 1:
                continue  # too few to tell, here and further down
            if abs(self.end[p] / n - self.end[q] / m) > bound:
                return False
            own, other = self.next[p], self.next[q]
            classes = [0.0] * len(CLASSES)  # many rare characters tell states apart only together
            for c in own.keys() | other.keys():
                a, b = own.get(c), other.get(c)
                apart = (a[1] if a else 0) / n - (b[1] if b else 0) / m
                classes[CLASS_OF[c]] += apart
                if abs(apart) > bound:
                    return False
                if a and b:
                    todo.append((self.find(a[0]), self.find(b[0])))
            if any(abs(x) > bound for x in classes):
                return False
        return True

    def merge(self, p: int, q: int) -> None:
        """q becomes p; where both have a character, the states that it leads to are merged as well."""
        todo = [(p, q)]
        while todo:
            p, q = map(self.find, todo.pop())
            if p == q:
                continue
            p, q = min(p, q), max(p, q)
            self.same[q] = p
            self.end[p] += self.end[q]
            for c, (to, n) in self.next[q].items():
                own = self.next[p].get(c)
                if own is None:
                    self.next[p][c] = [to, n]
                else:
                    own[1] += n
                    todo.append((own[0], to))
            self.next[q] = {}

    def merge_depths(self) -> None:
        """From the root down, states of one depth: the most travelled first, into the first that it is compatible with."""
        level = [0]
        while level:
            below = {self.find(to) for s in level for to, _ in self.next[s].values()}
            level = []
            for state in sorted(below, key=lambda x: (-self.seen(x), x)):
                if self.find(state) != state:
                    continue  # merged along with another
                to = next((r for r in level if self.compatible(r, state)), None)
                if to is None:
                    level.append(state)
                else:
                    self.merge(to, state)
            level = sorted({self.find(s) for s in level})

    def merge_across(self) -> None:
        """Red states are settled; a state that one of them leads to is merged into a compatible red one, or is red itself."""
        red: list[int] = []
        blue = [0]
        while blue:
            state = min(blue, key=lambda x: (-self.seen(x), x))  # the most travelled first: its statistics are the firmest
            to = next((r for r in red if self.compatible(r, state)), None)
            if to is None:
                red.append(state)
            else:
                self.merge(to, state)
            red = sorted({self.find(r) for r in red})
            blue = sorted({self.find(to) for r in red for to, _ in self.next[r].values()} - set(red))
        self.states = len(red)

    def step(self, state: int, c: str) -> tuple[float, int]:
        """log2 of the probability of a character ("" for the end) in a state, and the state after it.

        What the state hasn't seen has the odds of its class there, and leads where most of its class go, or most of all.
        """
        following = self.next[state]
        total = self.seen(state)
        if not c:
            return log2((self.end[state] + BACK * (self.end[state] + 0.5) / (total + 2.5)) / (total + BACK)), state
        kind = CLASSES[CLASS_OF[c]]
        of_class = sum(n for x, (_, n) in following.items() if x in kind)
        own = following.get(c, (None, 0))
        odds = log2((own[1] + BACK * (of_class + 0.5) / (total + 2.5) / len(kind)) / (total + BACK))
        if own[0] is None:
            near = [(n, x) for x, (_, n) in following.items() if x in kind] or [(n, x) for x, (_, n) in following.items()]
            own = following[max(near)[1]] if near else (state, 0)
        return odds, self.find(own[0])

    def score(self, value: str) -> float:
        """log2 of the probability of a whole string."""
        state, out, known = 0, 0.0, self.known
        for c in value:
            step = known[state].get(c)
            if step is None:
                step = known[state][c] = self.step(state, c)
            out += step[0]
            state = step[1]
        return out + self.step(state, "")[0]


SIGN, SIGN_BITS = re.compile(r"[+/_=.-]"), 4.0


class Ordinary:
    """Ordinary strings: pairs of characters within runs and at their edges (a blank), and classes where a pair is rare."""

    def __init__(self, pairs: dict[str, int]):
        classes: Counter[tuple[int, int]] = Counter()
        one: Counter[str] = Counter()
        from_class: Counter[int] = Counter()
        for (a, b), n in pairs.items():
            classes[self.kind(a), self.kind(b)] += n
            one[a] += n
            from_class[self.kind(a)] += n
        self.odds = {}
        signs = [*CLASS_OF, " "]
        for a in signs:
            for b in signs:
                back = (classes[self.kind(a), self.kind(b)] + 1) / (from_class[self.kind(a)] + 5) / (1 if b == " " else len(CLASSES[CLASS_OF[b]]))
                self.odds[a + b] = log2((1 - RARE) * (pairs.get(a + b, 0) + BACK * back) / (one[a] + BACK) + RARE * back)

    @staticmethod
    def kind(c: str) -> int:
        return CLASS_OF.get(c, -1)

    def pairs(self, value: str) -> float:
        odds, value = self.odds, f" {value} "
        return sum([odds[value[k : k + 2]] for k in range(len(value) - 1)])

    def score(self, value: str) -> float:
        """log2 of the probability of a string, as one word or as words with signs between them (paths, compounds), whichever is likelier."""
        words = SIGN.split(value)
        whole = self.pairs(value)
        return whole if len(words) == 1 else max(whole, sum(self.pairs(w) for w in words if w) - SIGN_BITS * (len(words) - 1))


class Formats:
    """Automata by kind, and the threshold of their log-likelihood ratio in bits for each character: half of what nearly all
    labelled values reach that are kept back from a first inference (0 is where both are as likely)."""

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[str, int]):
        self.ordinary = Ordinary(pairs)
        self.known: dict[str, float] = {}
        some = {k: v for k, v in labelled.items() if v}
        # a kind with a single value has nothing to keep back
        self.automata = {k: Automaton(Counter(v[len(v) // 5 :])) for k, v in some.items()}
        kept_back = sorted(self.ratio(x) for v in some.values() for x in v[: len(v) // 5])
        self.threshold = max(LEAST_BITS, kept_back[int(len(kept_back) * MISSED)] / 2) if kept_back else LEAST_BITS
        self.automata = {k: Automaton(Counter(v)) for k, v in some.items()}

    def ratio(self, value: str) -> float:
        """Bits for each character by which the likeliest automaton is above ordinary strings."""
        if not self.automata:
            return float("-inf")
        return (max(a.score(value) for a in self.automata.values()) - self.ordinary.score(value)) / (len(value) + 1)

    def is_secret(self, value: str) -> bool:
        if len(value) > 256:  # too long to keep
            return self.ratio(value) >= self.threshold
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known.get(value)
        if known is None:
            known = self.known[value] = self.ratio(value)
        return known >= self.threshold

    def within(self, text: str, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Secrets in text[begin:end]: whole runs, else parts of them."""
        for m in CANDIDATE.finditer(text, begin, end):
            if self.is_secret(m.group()):
                yield m.start(), m.end(), 3
                continue
            for x in PART.finditer(text, m.start(), m.end()):
                if x.span() != m.span() and self.is_secret(x.group()):
                    yield x.start(), x.end(), 3

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans: the fixed ones, and candidates in what is outside of them whose format is likely enough."""
        base = base_spans(text)
        if not self.automata:
            return base
        extra, at = [], 0
        for begin, end, _ in [*base, (len(text), len(text), 3)]:
            if begin - at >= LEAST:
                extra += self.within(text, at, begin)
            at = max(at, end)
        return sorted(base + extra, key=lambda s: (s[0], s[2])) if extra else base


def render(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


class Least:
    """The distinct values that come first by hash, at most `most` of them; parts merge into the whole."""

    def __init__(self, most: int):
        self.most, self.held, self.bound = most, {}, 1 << 64

    def add(self, value: str) -> None:
        h = xxhash.xxh3_64_intdigest(value)
        if h < self.bound:
            self.held[value] = h
            if len(self.held) > 4 * self.most:
                self.cut()

    def cut(self) -> None:
        first = sorted(self.held.items(), key=lambda x: (x[1], x[0]))[: self.most]
        self.held = dict(first)
        if len(first) == self.most:
            self.bound = first[-1][1] + 1


#: A number for each character of a run, 0 for all others.
_SIGNS = " " + "".join(c for c in CLASS_OF if c != ".")
_NUMBER = np.zeros(256, np.int16)
_NUMBER[[ord(c) for c in _SIGNS[1:]]] = range(1, len(_SIGNS))


#: A run that is long enough for a credential is ordinary if it is a word; letters without an end aren't one.
WORD_LIKE = re.compile(r"[A-Z]?[a-z]{1,63}|[A-Z]{1,64}")


def pair_counts(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """How often one character of a run follows another, or an edge, outside some spans: a flat table of len(_SIGNS) squared.

    Runs that may be credentials, other than words, don't count: they can't be evidence of what is ordinary.
    """
    # one byte for each code point, so that places are the same; what isn't ASCII ends a run, as "?" does
    x = _NUMBER[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    for a, b, _ in spans:
        x[a:b] = 0
    for m in CANDIDATE.finditer(text):
        if not WORD_LIKE.fullmatch(m.group()):
            x[m.start() : m.end()] = 0
    x = np.concatenate([[0], x, [0]]).astype(np.int64)
    return np.bincount(x[:-1] * len(_SIGNS) + x[1:], minlength=len(_SIGNS) ** 2)


def learn(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE) -> Formats:
    """Formats from the labelled values of all texts: of each kind the `sample` distinct values that come first by hash; tasks hold and send no
    more than that. Ordinary strings are the words and short runs of all texts outside labelled values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {k: Least(sample) for k in KINDS[:3]}
        pairs = np.zeros(len(_SIGNS) ** 2, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                spans = base_spans(text)
                for v, (_, _, k) in zip(values(text, spans), spans):
                    if len(v) <= LONGEST:
                        least[KINDS[k]].add(v)
                pairs += pair_counts(text, spans)
        for kind, x in least.items():
            x.cut()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(x.held), pa.string()), pa.array(list(x.held), pa.string()), pa.array([h - (1 << 63) for h in x.held.values()], pa.int64())], ["kind", "value", "h"])
        pairs[0] = 0
        some = np.flatnonzero(pairs).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(some), pa.string()), pa.array([_SIGNS[k // len(_SIGNS)] + _SIGNS[k % len(_SIGNS)] for k in some], pa.string()), pa.array(pairs[some], pa.int64())], ["kind", "value", "h"])

    found = table(map_batches(docs.select(text_column), run, "kind string, value string, h long"), "values")
    pairs = {r["value"]: r["n"] for r in found.filter("kind = ''").groupBy("value").agg(F.sum("h").alias("n")).collect()}
    labelled = found.filter("kind != ''").distinct()
    return Formats({kind: [r["value"] for r in labelled.filter(F.col("kind") == kind).orderBy("h", "value").limit(sample).collect()] for kind in KINDS[:3]}, pairs)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", formats: Formats | None = None) -> DataFrame:
    """Spans of secrets in every whole text. Returns id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    Null texts count as empty: no spans, the digest of the empty string. Equal spans of two kinds are both listed. Null and repeated ids
    are kept. An empty table gives an empty table; without labelled values nothing is added to the fixed patterns.
    """
    known = formats or learn(docs, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text in texts(batch.column(1)):
                spans = known.spans(text)
                n = Counter(k for _, _, k in spans)
                for column, value in zip(out, (n[0], n[1], n[2], hashlib.sha256(render(s for s in spans if s[2] < 3).encode()).hexdigest(), render(spans), n[3])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(out))], [id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return map_batches(docs.select(id_column, text_column), run, f"{id_column} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redact(docs: DataFrame, text_column: str = "text", formats: Formats | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced; overlapping spans are one. n_chars, where there is one, follows.

    Texts without spans stay as they are, to the byte; in the others bytes that are no UTF-8 become U+FFFD.
    """
    known = formats or learn(docs, text_column)
    names = docs.columns
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            for k, text in enumerate(texts(batch.column(at))):
                merged: list[list[int]] = []
                for a, b, _ in known.spans(text):
                    if merged and a < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                if merged:
                    kept = [text[a:b] for a, b in zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(text)])]
                    changed[k] = mark.join(kept)
            if changed:
                columns = list(batch.columns)
                data = columns[at].cast(pa.binary()).to_pylist()
                for k, text in changed.items():
                    data[k] = text.encode()
                # a view, since bytes needn't be UTF-8
                columns[at] = pa.array(data, pa.binary()).view(pa.string()).cast(columns[at].type) if columns[at].type != pa.string() else pa.array(data, pa.binary()).view(pa.string())
                if "n_chars" in names:
                    i = names.index("n_chars")
                    lengths = columns[i].to_pylist()
                    for k, text in changed.items():
                        lengths[k] = len(text)
                    columns[i] = pa.array(lengths, columns[i].type)
                batch = pa.RecordBatch.from_arrays(columns, names)
            yield batch

    return map_batches(docs, run, docs.schema)
