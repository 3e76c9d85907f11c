"""Personal data: patterns against plain regular expressions, the field against all segmentations."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefeed.llm import personal_data as P

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and checksum(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if checksum(digits + c))


def written(rng):
    number = "".join(rng.choice("123456789") for _ in range(10))
    return rng.choice([
        lambda: f"{rng.choice(['ann', 'bo.b', 'x_y'])}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: card(rng), lambda: " ".join(re.findall("....", card(rng))),
        lambda: f"+1 ({number[:3]}) {number[3:6]}-{number[6:]}",
    ])()


def corpus(rng, n):
    words = ["the", "note", "of", "Zürich", "and", "so", "mail", "room 12"]
    return [" ".join(written(rng) if rng.random() < 0.08 else rng.choice(words) for _ in range(60)) for _ in range(n)]


def test_patterns():
    rng = random.Random(1)
    parts = ["@", ".", "a", "é", "x.y", "com", "-", "+", " ", "(", ")", "1", "255", "256", "007", "4111", "1111", "4111111111111111", "😀", "\n",
             "a@b.c", "10.0.0.1", "+1 (555) 123-4567", "0" * 5000]
    for _ in range(3000):
        text = "".join(rng.choice(parts[:-1]) for _ in range(rng.randrange(40)))
        assert [(P.KINDS[s.kind], s.start, s.stop) for s in P.base_spans(text)] == brute_base(text), text
    # Linear in long runs.
    for text, n in (("1." * 40000, 10000), ("1 " * 40000, 0), ("a" * 40000 + "@", 0), ("+1" + "." * 40000, 0), ("@" * 40000, 0),
                    (parts[-1] + ".1.1.1", 1), ("1.2.3." + parts[-1], 1), ("9" * 5000 + ".1.1.1", 0)):
        assert len(P.base_spans(text)) == n


def segmentations(edges, size):
    """Every way from the first place to the last."""
    def walk(place):
        if place == size - 1:
            yield []
        else:
            yield from walk(place + 1)
            for e, (start, stop, _) in enumerate(edges):
                if start == place:
                    for rest in walk(stop):
                        yield [e, *rest]

    return list(walk(0))


def value(way, edges, scores, links):
    total, place, last = 0.0, 0, P.OTHER
    for e in way:
        start, stop, kind = edges[e]
        total += scores[e] + links[last if start == place else P.OTHER, kind]
        place, last = stop, kind
    return total


def test_field_against_all_segmentations():
    rng = random.Random(2)
    for _ in range(60):
        spans = [(*sorted(rng.sample(range(7), 2)), rng.randrange(4)) for _ in range(rng.randrange(1, 8))]
        lattice = P.Lattice(spans)
        scores = [rng.gauss(0, 2) for _ in spans]
        links = np.array([[rng.gauss(0, 1) if k < P.OTHER else 0.0 for k in range(5)] for _ in range(5)])
        ways = segmentations(lattice.edges, lattice.size)
        values = np.array([value(w, lattice.edges, scores, links) for w in ways])
        total, likely, _ = lattice.expectations(scores, links)
        assert np.isclose(total, np.logaddexp.reduce(values))
        share = np.exp(values - total)
        assert np.allclose(likely, [sum(s for s, w in zip(share, ways) if e in w) for e in range(len(spans))])
        assert np.isclose(value(lattice.best(scores, links), lattice.edges, scores, links), values.max())


def test_training_raises_the_likelihood():
    counts = {}
    for text in corpus(random.Random(3), 150):
        for form in P.training_lattices(text):
            counts[form] = counts.get(form, 0) + 1
    lattices = sorted(counts.items())
    assert 10 < len(lattices) and any('"email"' in f for f in counts) and any('"phone"' in f for f in counts)

    def likelihood(field):
        total = 0.0
        for form, _ in lattices:
            edges = json.loads(form)
            graph = P.Lattice([e[:3] for e in edges])
            scores = [sum(field.weights[f"{k}:{f}"] for f in fs) for _, _, k, fs, _ in edges]
            way = sorted((e for e, edge in enumerate(edges) if edge[4]), key=lambda e: graph.edges[e])
            total += value(way, graph.edges, scores, field.links) - graph.expectations(scores, field.links)[0]
        return total / len(lattices)

    steps = [likelihood(P.fit(lattices, epochs)) for epochs in (0, 5, 60)]
    assert steps[0] < steps[1] < steps[2] and steps[2] > -0.15
    assert P.fit([]).weights == {} and P.added_spans("+1 (555) 123-4567", [], P.fit([])) == []


DOCS = "doc_id long, text string, spans string, SCORE string, base string"


def test_find(spark):
    rng = random.Random(4)
    texts = corpus(rng, 250)
    a, b, ip, phone = card(rng), card(rng), "10.20.30.40", "+1 (555) 123-4567"
    swallowed = [(f"so {phone} {a} and", [phone, a]), (f"of {a} {b} the", [a, b]), (f"the {phone} {ip} so", [phone])]
    clean = ["Nothing here, at all.", "room 12 on 2024-01-02", "version 1.2.3", "1 2 3 4 5 6 7 8 9", "x @ y", "7 " * 3000, "9" * 4000, "5." * 4000]
    odd = [None, "", "word " * 60000 + phone]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate([*texts, *(t for t, _ in swallowed), *clean, *odd, texts[0]])] + [(None, phone, "x", "y", "z")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    field = P.train(docs)
    out = P.find(docs, field)
    assert out.columns == ["doc_id", "text", "SCORE", "base", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s.kind, s.start, s.stop) for s in r.spans]
        assert [s for s, t in zip(spans, r.spans) if t.base] == brute_base(r.text)
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1]))
        for s in r.spans:
            if not s.base:
                assert s.score is not None and not any(o is not s and o.start < s.stop and s.start < o.stop for o in r.spans)
        # The patterns' own reports are not added to where they stand alone.
        if r.text in clean:
            assert [s for s in r.spans if not s.base] == [], r.text[:40]
    found = {r.text: {r.text[s.start:s.stop] for s in r.spans} for r in got if r.text}
    for text, parts in swallowed:
        assert set(parts) <= found[text], text
        assert set(parts) - {text[x[1]:x[2]] for x in brute_base(text)}
    (again,) = {str(r.spans) for r in got if r.text == texts[0]}
    assert again
    # All of the documents, so the field does not depend on how they are dealt.
    assert P.train(docs.repartition(7)).weights == field.weights
    digests = {r.doc_id: r for r in P.report(docs, field).collect()}
    for r in got:
        base = [s for s in r.spans if s.base]
        text = ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in base)
        d = digests[r.doc_id]
        assert d.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert d.spans == ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.spans)
        assert [d[f"n_{k}"] for k in P.KINDS] == [sum(s.kind == k for s in base) for k in P.KINDS]


def test_redact_and_nothing(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(corpus(rng, 200))], DOCS)
    field = P.train(docs)
    some = spark.createDataFrame([(1, "call +1 (555) 123-4567 or a@b.cd.", "x", "y", "z"), (2, None, "x", "y", "z"), (3, "plain", "x", "y", "z"), (4, "", "x", "y", "z")], DOCS)
    cut = P.redact(some, field)
    assert cut.columns == some.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "call [phone] or [email].", 2: None, 3: "plain", 4: ""}
    assert P.find(docs.limit(0), field).count() == 0
    nothing = P.train(docs.limit(0))
    assert nothing.weights == {} and P.find(some, nothing).where(F.size("spans") > 0).count() == 1
