"""Personal data in text: plain patterns, and a semi-Markov conditional random field beside them.

The patterns report addresses, numbers and so on wherever one matches and passes its test. They
read greedily: a number that stands beside another one is swallowed, the whole fails its test, and
nothing is found. The field finds such spans. It scores whole segments: a candidate is a run of
tokens of bounded length that could be an entity of some kind, and its features look at all of it
(grouping of digits, separators, labels of a domain) and at what stands on either side. Dynamic
programming over a region of overlapping candidates then chooses boundaries and kinds together,
text outside of entities being segments of kind "other". Features of adjacent kinds link segments.

The field is trained here, by likelihood, on what the patterns find: regions of the corpus with
the patterns' spans as their segments. Regions where a pattern's own match failed but holds another
candidate of its kind are what training cannot judge, and are left out. Regions become lattices of
features without any text of their own, so a corpus has few different ones; they are counted over
all documents and the ``LATTICES`` most frequent are fitted.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefeed.llm.rows import add_columns, fresh

LATTICES = 300
EPOCHS = 60
RATE = 0.5
L2 = 0.002
LATTICE_CANDIDATES = 64  # a region of more is not trained on, but decoded like any other

# --- fixed values: what the patterns report ---
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Words that announce an entity.
CUES = {
    "email": ("email", "e-mail", "mail", "mailto", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
}
# --- end of fixed values ---

EMAIL, IP, CARD, PHONE = range(4)
OTHER = 4

MAX_RUNS = 19  # runs of digits in a candidate
MAX_PHONE_RUNS = 6
MAX_LOCAL, MAX_LABELS = 64, 6


class Span(NamedTuple):
    kind: int
    start: int
    stop: int


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 if d > 4 else 2 * d for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_octet(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) < 3 or (len(significant) == 3 and significant <= "255")


# --- the patterns ---------------------------------------------------------------------------


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        # Left of here nothing can be part of a later match but what follows this sign.
        free = found.end() if found else at + 1
        at = text.find("@", free)


def pattern_matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Every leftmost match of every kind's pattern, and whether it passes the kind's test."""
    for start, stop in _emails(text):
        yield Span(EMAIL, start, stop), True
    for m in _IP.finditer(text):
        yield Span(IP, *m.span()), all(map(_is_octet, m[0].split(".")))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if len(m[0]) <= 37 else ""
        yield Span(CARD, *m.span()), 13 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield Span(PHONE, *m.span()), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15


def base_spans(text: str) -> list[Span]:
    """What the patterns report, by kind and place."""
    return sorted(span for span, passed in pattern_matches(text) if passed)


# --- candidates and their features ----------------------------------------------------------


class Candidate(NamedTuple):
    start: int
    stop: int
    kind: int
    features: tuple[str, ...]


_RUN = re.compile(r"[0-9]++")
_GAP = re.compile(r"[\x20().-]{1,3}")
_WORD = re.compile(r"\w")


def _beside(char: str) -> str:
    if not char:
        return "edge"
    if char.isspace():
        return "space"
    return "digit" if char.isdigit() else "letter" if char.isalpha() else char if char in "@.+-_(),:;" else "mark"


def _cue(text: str, start: int, kind: int) -> bool:
    before = re.findall(r"[\w-]+", text[max(0, start - 32):start].lower())[-3:]
    return any(word in CUES[KINDS[kind]] for word in before)


def _around(text: str, start: int, stop: int, kind: int) -> list[str]:
    left, right = text[start - 1:start], text[stop:stop + 1]
    out = [f"left={_beside(left)}", f"right={_beside(right)}"]
    # A number that goes on after a separator.
    if left in (" ", "-", ".") and text[start - 2:start - 1].isdigit():
        out.append(f"digit before {left}")
    if right in (" ", "-", ".") and text[stop + 1:stop + 2].isdigit():
        out.append(f"digit after {right}")
    if _cue(text, start, kind):
        out.append("cue")
    return out


def _email_candidates(text: str) -> Iterator[Candidate]:
    at = text.find("@")
    while at >= 0:
        starts, start = [], at
        while start > 0 and at - start < MAX_LOCAL and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
            start -= 1
            if _WORD.match(text, start) and (start == 0 or not text[start - 1].isalnum()):
                starts.append(start)
        stops, stop, labels = [], at + 1, 0
        while labels < MAX_LABELS:
            label = stop
            while stop < len(text) and stop - label < 63 and (text[stop].isalnum() or text[stop] == "-"):
                stop += 1
            if stop == label:
                break
            labels += 1
            if labels > 1:
                stops.append((stop, labels, text[label:stop]))
            if text[stop:stop + 1] != ".":
                break
            stop += 1
        for start in starts:
            for stop, labels, last in stops:
                local = text[start:at]
                features = [
                    "email", f"labels={labels}", "name last" if last.isalpha() and len(last) > 1 else "no name last",
                    "plain" if text[start:stop].isascii() else "other letters", f"local ends {_beside(local[-1])}",
                ]
                yield Candidate(start, stop, EMAIL, tuple(features + _around(text, start, stop, EMAIL)))
        at = text.find("@", at + 1)


def _number_candidates(text: str) -> Iterator[Candidate]:
    runs = [m.span() for m in _RUN.finditer(text)]
    for i, (start, _) in enumerate(runs):
        digits, gaps, lengths = "", [], []
        for j in range(i, min(i + MAX_RUNS, len(runs))):
            low, stop = runs[j]
            if j > i:
                gap = text[runs[j - 1][1]:low]
                if len(gap) > 3 or not _GAP.fullmatch(gap):
                    break
                gaps.append(gap)
            if len(digits) + stop - low > 19:
                break
            digits += text[low:stop]
            lengths.append(stop - low)
            shape = "-".join(map(str, lengths))
            if len(lengths) == 4 and gaps == ["."] * 3 and all(n < 4 and _is_octet(text[a:b]) for n, (a, b) in zip(lengths, runs[i:j + 1])):
                yield Candidate(start, stop, IP, ("ip", *_around(text, start, stop, IP)))
            if len(digits) >= 13 and set(gaps) <= {" ", "-"} and luhn(digits):
                features = ["card", f"digits={len(digits)}", f"groups={shape if len(lengths) < 5 else 'many'}"]
                yield Candidate(start, stop, CARD, tuple(features + [f"gap={g}" for g in sorted(set(gaps))] + _around(text, start, stop, CARD)))
            if 9 <= len(digits) <= 15 and len(lengths) <= MAX_PHONE_RUNS:
                first = start
                if first and text[first - 1] == "(" and ")" in text[start:stop]:
                    first -= 1
                plus = first > 0 and text[first - 1] == "+"
                first -= plus
                inside = text[first:stop]
                if inside.count("(") == inside.count(")"):
                    features = ["plus" if plus else "no plus", "phone", f"digits={len(digits)}", f"groups={shape}", f"gaps={'|'.join(gaps)}"]
                    yield Candidate(first, stop, PHONE, tuple(features + _around(text, first, stop, PHONE)))


def candidates(text: str) -> list[Candidate]:
    """Every segment that may be an entity, by place."""
    found = [*_email_candidates(text)] if "@" in text else []
    return sorted([*found, *_number_candidates(text)], key=lambda c: c[:3])


def regions(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Candidates that overlap or touch, directly or through others."""
    part, stop = [], -1
    for one in found:
        if part and one.start > stop:
            yield part
            part = []
        part.append(one)
        stop = max(stop, one.stop)
    if part:
        yield part


# --- the field ------------------------------------------------------------------------------


class Lattice:
    """A region as a graph: places where candidates begin or end, and candidates between them."""

    def __init__(self, edges: list[tuple[int, int, int]]):
        places = sorted({p for start, stop, _ in edges for p in (start, stop)})
        index = {p: i for i, p in enumerate(places)}
        self.size = len(places)
        self.edges = [(index[start], index[stop], kind) for start, stop, kind in edges]
        self.into: list[list[int]] = [[] for _ in places]
        for e, (_, stop, _) in enumerate(self.edges):
            self.into[stop].append(e)

    def forward(self, scores, links: np.ndarray) -> np.ndarray:
        """Log sums over all ways to a place, by the kind of the last segment."""
        alpha = np.full((self.size, OTHER + 1), -np.inf)
        alpha[0, OTHER] = 0.0
        for place in range(1, self.size):
            alpha[place, OTHER] = np.logaddexp.reduce(alpha[place - 1])
            for e in self.into[place]:
                start, _, kind = self.edges[e]
                reached = np.logaddexp.reduce(alpha[start] + links[:, kind]) + scores[e]
                alpha[place, kind] = np.logaddexp(alpha[place, kind], reached)
        return alpha

    def expectations(self, scores, links: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the sum over all segmentations, how likely each candidate is a segment, and how
        often each kind is expected to follow each."""
        alpha = self.forward(scores, links)
        total = np.logaddexp.reduce(alpha[-1])
        beta = np.full((self.size, OTHER + 1), -np.inf)
        beta[-1] = 0.0
        out: list[list[int]] = [[] for _ in range(self.size)]
        for e, (start, _, _) in enumerate(self.edges):
            out[start].append(e)
        likely, follows = np.zeros(len(self.edges)), np.zeros(links.shape)
        for place in range(self.size - 2, -1, -1):
            beta[place] = beta[place + 1, OTHER]
            for e in out[place]:
                _, stop, kind = self.edges[e]
                rest = links[:, kind] + scores[e] + beta[stop, kind]
                flow = np.exp(alpha[place] + rest - total)
                likely[e] = flow.sum()
                follows[:, kind] += flow
                beta[place] = np.logaddexp(beta[place], rest)
        return float(total), likely, follows

    def best(self, scores, links: np.ndarray) -> list[int]:
        """The candidates of the best segmentation."""
        value = np.full((self.size, OTHER + 1), -np.inf)
        edge = np.full((self.size, OTHER + 1), -1, dtype=np.int64)
        before = np.full((self.size, OTHER + 1), OTHER, dtype=np.int8)
        value[0, OTHER] = 0.0
        for place in range(1, self.size):
            last = int(value[place - 1].argmax())
            value[place, OTHER], before[place, OTHER] = value[place - 1, last], last
            for e in self.into[place]:
                start, _, kind = self.edges[e]
                ways = value[start] + links[:, kind]
                last = int(ways.argmax())
                if ways[last] + scores[e] > value[place, kind]:
                    value[place, kind], edge[place, kind], before[place, kind] = ways[last] + scores[e], e, last
        place, kind, out = self.size - 1, int(value[-1].argmax()), []
        while place:
            e, last = int(edge[place, kind]), int(before[place, kind])
            if kind == OTHER:
                place -= 1
            else:
                out.append(e)
                place = self.edges[e][0]
            kind = last
        return out[::-1]


class Field(NamedTuple):
    """Trained weights: of features by kind, and of a kind that follows a kind."""

    weights: dict[str, float]
    links: np.ndarray

    def score(self, candidate: Candidate) -> float:
        return sum(self.weights.get(f"{candidate.kind}:{f}", 0.0) for f in candidate.features)


def _clear_of(found: list[Candidate], spans: list[Span]) -> list[Candidate]:
    """Candidates that overlap none of the spans."""
    merged: list[list[int]] = []
    for start, stop in sorted((s.start, s.stop) for s in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    starts = [m[0] for m in merged]

    def clear(c):
        i = bisect.bisect_left(starts, c.stop) - 1
        return i < 0 or merged[i][1] <= c.start

    return [c for c in found if clear(c)] if merged else found


def added_spans(text: str, base: list[Span], field: Field) -> list[tuple[Span, float]]:
    """Segments that the field chooses where the patterns report nothing, with their scores."""
    out = []
    for part in regions(_clear_of(candidates(text), base)):
        scores = [field.score(c) for c in part]
        # Nothing can gain where no candidate does.
        if max(scores) + max(0.0, float(field.links.max())) <= 0:
            continue
        lattice = Lattice([c[:3] for c in part])
        out += [(Span(part[e].kind, part[e].start, part[e].stop), scores[e]) for e in lattice.best(scores, field.links)]
    return out


def training_lattices(text: str) -> Iterator[str]:
    """The regions of a text that can be trained on, as text without content: for each candidate
    its places, kind, features and whether the patterns report it."""
    matches = [*pattern_matches(text)]
    passed, failed = [s for s, ok in matches if ok], [s for s, ok in matches if not ok]
    marked: list[Span] = []
    for span in sorted(passed, key=lambda s: (s.start, s.kind)):
        if not marked or span.start >= marked[-1].stop:
            marked.append(span)
    gold, starts = set(marked), [s.start for s in marked]
    by_kind = {k: sorted((s.start, s.stop) for s in failed if s.kind == k) for k in range(OTHER)}

    def doubtful(c: Candidate) -> bool:
        spans = by_kind[c.kind]
        i = bisect.bisect_left(spans, (c.stop,)) - 1
        return i >= 0 and spans[i][1] > c.start and Span(c.kind, c.start, c.stop) not in gold

    for part in regions(candidates(text)):
        if len(part) > LATTICE_CANDIDATES or any(map(doubtful, part)):
            continue
        low, high = part[0].start, max(c.stop for c in part)
        around = marked[max(0, bisect.bisect_right(starts, low) - 1):bisect.bisect_left(starts, high)]
        if not {s for s in around if s.stop > low} <= {Span(c.kind, c.start, c.stop) for c in part}:
            continue  # a reported span that is no candidate
        places = {p: i for i, p in enumerate(sorted({p for c in part for p in (c.start, c.stop)}))}
        yield json.dumps([
            [places[c.start], places[c.stop], c.kind, c.features, Span(c.kind, c.start, c.stop) in gold] for c in part
        ])


def fit(lattices: list[tuple[str, int]], epochs: int = EPOCHS) -> Field:
    """Weights that make the marked segments likely. Frequent lattices count more, by the logarithm
    of how often they occur. Without lattices nothing is ever chosen."""
    parsed = [(json.loads(text), math.log1p(count)) for text, count in lattices]
    names: dict[str, int] = {}
    graphs = []
    for edges, weight in parsed:
        features = [[names.setdefault(f"{kind}:{f}", len(names)) for f in found] for _, _, kind, found, _ in edges]
        graph = Lattice([(a, b, k) for a, b, k, _, _ in edges])
        marked = np.array([float(g) for *_, g in edges])
        follows, last, place = np.zeros((OTHER + 1, OTHER + 1)), OTHER, 0
        for start, stop, kind in sorted(graph.edges[e] for e in np.flatnonzero(marked)):
            last = OTHER if start > place else last
            follows[last, kind] += 1
            last, place = kind, stop
        graphs.append((graph, features, marked, follows, weight))
    weights, links = np.zeros(len(names)), np.zeros((OTHER + 1, OTHER + 1))
    total = sum(g[-1] for g in graphs) or 1.0
    seen_w, seen_l = np.full(len(names), 1e-8), np.full(links.shape, 1e-8)
    for _ in range(epochs if graphs else 0):
        up_w, up_l = -L2 * weights, -L2 * links
        for graph, features, marked, follows, weight in graphs:
            _, likely, expected = graph.expectations([weights[f].sum() for f in features], links)
            share = weight / total
            for f, gain in zip(features, share * (marked - likely)):
                up_w[f] += gain
            up_l += share * (follows - expected)
        # Steps shrink with the slopes a weight has seen.
        seen_w += up_w * up_w
        seen_l += up_l * up_l
        weights += RATE * up_w / np.sqrt(seen_w)
        links += RATE * up_l / np.sqrt(seen_l)
    links[:, OTHER] = 0.0
    return Field({name: float(weights[i]) for name, i in names.items()}, links)


# --- over a table ---------------------------------------------------------------------------

SCHEMA = "spans array<struct<kind:string,start:int,stop:int,base:boolean,score:double>>"
_LIST = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("score", pa.float64()),
]))


def _worth_reading(text: Column) -> Column:
    """The text, or NULL where no kind can occur."""
    return F.when(text.rlike("[0-9@]"), text)


def train(docs: DataFrame, text: str = "text", lattices: int = LATTICES, epochs: int = EPOCHS) -> Field:
    """A field trained on what the patterns find in all documents: on the ``lattices`` most frequent
    forms of regions, ties by the form itself."""
    texts = docs.select(_worth_reading(docs[text].cast("string")).alias("text")).where("text is not null")

    def run(batches):
        for batch in batches:
            found = [form for t in batch.column(0).to_pylist() for form in training_lattices(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["form"])

    counts = texts.mapInArrow(run, "form string").groupBy("form").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "form").limit(lattices).collect()
    return fit([(r.form, r.n) for r in top], epochs)


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: kind, start, stop (code points, end exclusive), whether a pattern
    reports it (``base``), and the field's score of those that it adds; by kind as in ``KINDS``, then
    start. Added spans overlap no other span.

    NULL and empty texts have none. Repeated rows get equal results; a column named ``spans`` is
    replaced, all others stay. An empty table gives an empty one.
    """
    def scan(arrays: list[pa.Array]) -> list[pa.Array]:
        out = []
        for t in arrays[0].to_pylist():
            if not t:
                out.append([])
                continue
            base = base_spans(t)
            rows = [(s, True, None) for s in base] + [(s, False, score) for s, score in added_spans(t, base, field)]
            rows.sort(key=lambda r: r[0])
            out.append([{"kind": KINDS[s.kind], "start": s.start, "stop": s.stop, "base": b, "score": score} for s, b, score in rows])
        return [pa.array(out, _LIST)]

    return add_columns(docs, [_worth_reading(docs[text].cast("string"))], SCHEMA, scan)


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in square brackets; of overlapping
    spans the whole stretch is replaced, by the kind that begins first. The columns stay."""
    name = fresh("text")

    def cut(arrays: list[pa.Array]) -> list[pa.Array]:
        out = []
        for t in arrays[0].to_pylist():
            if not t:
                out.append(None)
                continue
            base = base_spans(t)
            kept, at = [], 0
            for span in sorted([*base, *(s for s, _ in added_spans(t, base, field))], key=lambda s: (s.start, -s.stop)):
                if span.start >= at:
                    kept += [t[at:span.start], f"[{KINDS[span.kind]}]"]
                at = max(at, span.stop)
            out.append("".join(kept) + t[at:])
        return [pa.array(out, pa.string())]

    made = add_columns(docs, [_worth_reading(docs[text].cast("string"))], f"{name} string", cut)
    return made.select(*[F.coalesce(made[name], made[text].cast("string")).alias(text) if c == text else made[c] for c in docs.columns])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(docs: DataFrame, field: Field) -> DataFrame:
    """One digest row per document."""
    found = find(docs.select("doc_id", "text"), field)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
