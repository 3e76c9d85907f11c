"""The operators against brute force, and on NULLs, empty tables, ties and clashing names."""

import bisect
import collections
import datetime as dt
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolefeed.llm import (
    archives, components, decontaminate, jaccard_join, line_dedup, neighbours, packing, packing_plan,
    quality, secret_scan, token_counts, tokens, url_lists,
)
from rolefeed.session import shared_dir

DOCS = "doc_id long, text string, source string, n_lines string, linked string, hits string, score string, spans string"


def docs(spark, rows):
    """Documents with columns named like those that operators add."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- line dedup -----------------------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(i, f"Menu \nstory {i}\n\nMenu\n", "a") for i in range(6)]
    rows += [(10, "Menu\nonly here", "b"), (11, None, "a"), (12, "", None), (None, "Menu", "a"), (None, "Menu", "a")]
    out = line_dedup.drop_boilerplate(docs(spark, rows), max_ratio=0.5, min_pages=3)
    assert out.columns[:3] == ["doc_id", "text", "source"] and out.columns[-2:] == ["n_lines", "n_dropped"]
    found = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert found == collections.Counter([
        *((i, f"story {i}\n\n", 5, 2) for i in range(6)), (10, "Menu\nonly here", 2, 0), (11, None, 0, 0), (12, "", 1, 0),
        (None, "", 1, 1), (None, "", 1, 1),
    ])
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


# --- Jaccard join ---------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return out


def test_near_duplicates(spark):
    rng = random.Random(3)
    passage = prose(rng, 55)
    rows, n = [(None, "lonely text without an id here"), (900, None), (901, ""), (902, " \n"), (903, "Two Words"), (904, "two  words")], 0
    for size in (8, 30, 120, 400):
        for family in range(4):
            base = prose(rng, size, 5000).split()
            for copy in range(7):
                words = list(base)
                for _ in range(rng.randrange(0, 1 + size // 25)):
                    words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
                text = " ".join(words) + (" " + passage if family % 2 else "")
                rows.append((n, text))
                n += 1
    rows += [(n, rows[10][1].upper()), (None, rows[10][1]), (rows[20][0], rows[20][1])]
    out = jaccard_join.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())
    assert got == collections.Counter(brute_components(rows))
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def matrix_pairs(spark, texts):
    """Pairs that the matrix alone leaves, as numbers of texts; every class is its own group."""
    corpus = jaccard_join._Corpus(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), "doc_id", "text")
    ids = {bytes(r.key): r.doc_id for r in corpus.rows.where("n > 0").select("key", "doc_id").collect()}
    alone = spark.createDataFrame([], "key binary, grp long")
    return {tuple(sorted((ids[bytes(r.a)], ids[bytes(r.b)]))) for r in jaccard_join._matrix_pairs(corpus, alone).collect()}


@pytest.mark.parametrize("small, shared, large", [(75, 75, 100), (90, 90, 104), (94, 90, 104)])
def test_matrix_keeps_contained_copies(spark, small, shared, large):
    # The larger set's prefix is nearly all of its own rare tokens, so most of the smaller one's
    # prefix is behind it.
    same = [f"w{i}" for i in range(shared + 4)]
    texts = [" ".join([*same, *(f"{own}{i}" for i in range(n - shared))]) for own, n in (("a", small), ("b", large))]
    assert matrix_pairs(spark, texts) == {(0, 1)}


def test_matrix_keeps_all_links(spark):
    # Cut, extended and contained copies beside passages that many texts quote, without pivots.
    rng = random.Random(12)
    passages, texts = [prose(rng, 60, 5000) for _ in range(2)], []
    for family in range(24):
        base = prose(rng, rng.choice([20, 79, 200]), 10**6).split()
        n = len(base)
        copies = [base, base[:n * 4 // 5], base[n // 5:], [*base, *prose(rng, n // 4, 10**6).split()],
                  [*base[n // 10:], *prose(rng, n // 8, 10**6).split()], [*base, *prose(rng, n // 3, 10**6).split()]]
        for i, words in enumerate(copies):
            texts.append(" ".join(words) + (" " + passages[(family + i) % 2] if family % 3 else ""))
    same = [f"w{i}" for i in range(79)]
    texts += [" ".join(same), " ".join([*same, *(f"b{i}" for i in range(25))])]
    sets = [shingles(t) for t in texts]
    links = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
             if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert (len(texts) - 2, len(texts) - 1) in links and len(links) > 50
    assert links <= matrix_pairs(spark, texts)


def test_keep_one(spark):
    text = "one two three four five six seven eight"
    rows = [(2, text, "s"), (1, text, "s"), (1, text, "s"), (None, text, "s"), (None, "other", "s"), (3, "", "s"), (4, None, "s"), (4, None, "s")]
    kept = jaccard_join.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(
        [(1, text), (None, "other"), (3, ""), (4, None), (4, None)])


def test_low_bits_never_rule_out_partners():
    rng = np.random.default_rng(1)
    for n in (1, 7, 4000, 4500, 70000):
        a = np.unique(rng.integers(-2**63, 2**63, n))
        b = np.unique(np.r_[a[:int(len(a) * 0.9)], rng.integers(-2**63, 2**63, len(a) // 12)])
        if jaccard_join.similar(a, b):
            assert jaccard_join.may_be_similar(jaccard_join._short(a), jaccard_join._short(b), len(a), len(b))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(5, 5)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(x, find(x)) for x in root}


# --- decontamination ------------------------------------------------------------------------


def brute_hits(text, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))

    doc, hit, names = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j:j + k] == w[i:i + k]:
                    hit |= {*range(j, j + k)}
                    names.add(str(item))
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_contamination(spark, slice_bytes):
    rng = random.Random(2)
    items = [(1, prose(rng, 14, 50)), (12, "Only  THREE-words"), (3, None), (4, " ?!"), (5, prose(rng, 11, 50)), (5, "é ü 中")]
    rows = [(0, prose(rng, 40, 50)), (1, None), (2, ""), (3, f"before {items[0][1].upper()} after"),
            (4, items[0][1][5:] + ". " + items[4][1]), (5, "x only, three words y é-Ü é ü 中"), (None, items[4][1]), (None, items[4][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    source = docs(spark, [(i, t, "s") for i, t in rows])
    out = decontaminate.contamination_report(source, table, slice_bytes=slice_bytes)
    want = collections.Counter((i, *brute_hits(t, items)) for i, t in rows)
    assert collections.Counter(tuple(r) for r in out.collect()) == want
    cleaned = decontaminate.remove_spans(source, table, slice_bytes=slice_bytes)
    assert cleaned.columns == source.columns
    left = cleaned.collect()
    assert len(left) == len(rows) and all(brute_hits(r.text, items)[1] == 0 for r in left)
    assert {r.text for r in left if r.doc_id == 3} == {"before  after"}
    assert {r.doc_id for r in decontaminate.remove_documents(source, table).collect()} == {0, 1, 2}
    assert decontaminate.contamination_report(source, table.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("slice_bytes, depth", [(1 << 20, 14), (15, 4)])
def test_spans_that_form_by_cutting(spark, slice_bytes, depth):
    items = [(i, f"x{i} y{i}") for i in range(depth)]
    nested = " ".join([*(f"x{i}" for i in reversed(range(depth))), *(f"y{i}" for i in range(depth))])
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.remove_spans(docs(spark, [(0, f"before {nested} after", "s")]), table, n=2, slice_bytes=slice_bytes)
    assert out.first().text.split() == ["before", "after"]


def test_windows_are_small(spark):
    """Arrays of a few times the text, whatever it repeats, and the same items by them as by brute force."""
    import pickle

    rng = random.Random(22)
    passage = prose(rng, 30, 50)
    items = [(str(i), prose(rng, 60, 5000) + (" " + passage if i % 3 == 0 else "")) for i in range(2000)]
    windows = decontaminate.Windows(items, 10)
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(windows)) < 6 * size
    texts = [passage, items[5][1], "x " + items[6][1][:200], prose(rng, 50)]
    counts, hits, names = decontaminate._scan(pa.array(texts), windows)
    for i, text in enumerate(texts):
        n_words, n_hit, n_items, digest, _ = brute_hits(text, [x for x in items if int(x[0]) < 9 or int(x[0]) % 3 == 0][:60])
        assert counts[i].as_py() == n_words and len(hits[i]) == n_hit
    assert len(names[0]) == 667 and names[1].as_py() == ["5"] and names[3].as_py() == []
    # Beyond what a worker remembers.
    for at in range(0, 6000):
        word = windows.by_length[10][1][at]
        words = b" ".join(windows.text[s:e] for s, e in zip(windows.starts[word:word + 10], windows.ends[word:word + 10]))
        assert str(windows.ids[windows.by_length[10][2][at]]) in windows.items(10, int(windows.by_length[10][0][at]), words)
    assert len(windows._known) <= decontaminate.REMEMBERED


# --- token counts ---------------------------------------------------------------------------


def test_edits_agree_with_counting_again(spark):
    counted = token_counts.counter(*token_counts.default_vocabulary())
    rng = random.Random(4)
    parts = ["word", " and", "  ", "\n", " 12", "!?", "'s", "é", "中文", " x", "\t \n ", "I've", "a" * 90]
    for n in (0, 1, 3, 900):
        text = "".join(rng.choice(parts) for _ in range(n))
        tree = token_counts.Tree(*counted.count(text))
        for _ in range(60):
            start = rng.randrange(len(text) + 1)
            stop = min(len(text), start + rng.choice([0, 0, 1, 5, 200]))
            insert = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 120])))
            expected = text[:start] + insert + text[stop:]
            text, _ = tree.edit(text, start, stop, insert, counted)
            assert text == expected
            lengths, counts = counted.count(text)
            assert [list(x) for x in tree.flat()] == [list(lengths), list(counts)]
            assert tree.n_tokens == sum(counts) == len(counted.encoding.encode_ordinary(text))
            assert tree.sums[1, 0] == len(text)


def test_edit_tables(spark):
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(0, long, [(5, 5, "!")]), (1, None, [(0, 9, "new text")]), (2, "", None), (3, "abc", [None, (99, 200, " d"), (None, 1, None)])]
    table = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,stop:long,insert:string>>")
    out = {r.doc_id: r for r in token_counts.apply_edits(token_counts.build_trees(table)).collect()}
    assert [out[i].text for i in (1, 2, 3)] == ["new text", "", "bc d"]
    assert out[0].n_recounted < 100 and out[2].n_tokens == 0
    log = spark.createDataFrame([(7, 2, 0, 0, "b"), (7, 1, 0, 0, "a")], "doc_id long, seq long, start long, stop long, insert string")
    assert [e.insert for e in token_counts.collected_edits(log).first().edits] == ["a", "b"]


# --- nearest neighbours ---------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:160] = x[100]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (None, x[0].tolist()), (5005, [1.0] * 3)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, table.where("vec_id % 20 = 0"), leaf_rows=64, share=1.0).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in range(3000) if i % 20 == 0}
    hits = 0
    for q, listed in got.items():
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20]
        hits += len({*best.tolist()} & {i for i, _ in listed})
        assert len(listed) == 20 and listed == sorted(listed, key=lambda e: (-e[1], e[0]))
        assert np.allclose([s for _, s in listed], [scores[i] for i, _ in listed])
    assert hits >= 0.9 * 20 * len(got)
    few = table.where("vec_id in (0, 1, 20)")
    assert sorted((r.query_id, r.vec_id) for r in neighbours.nearest(few, few.where("vec_id % 20 = 0")).collect()) == [
        (0, 1), (0, 20), (20, 0), (20, 1)]
    assert neighbours.nearest(table.limit(0), table).count() == 0


# --- archives -------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([
        (1, "http://a/x y", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "dns:x", "z" * 300000),
        (None, "http://c", "<p>é</p>"), (6, "http://d", "WARC/1.0\r\n\r\n"), (6, "http://d", "WARC/1.0\r\n\r\n"),
    ], "page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.round_trip(pages).collect()}
    e, nothing, z, w = (archives.digest(t.encode()) for t in ("<p>é</p>", "", "z" * 300000, "WARC/1.0\r\n\r\n"))
    assert got == {
        (1, 9, e, "revisit", 2), (2, 9, e, "response", None), (None, 9, e, "revisit", 2), (3, 0, nothing, "revisit", 4),
        (4, 0, nothing, "response", None), (5, 300000, z, "response", None), (6, 12, w, "response", None), (6, 12, w, "revisit", 6),
    }
    kinds = collections.Counter(r.record_type for r in archives.round_trip(pages, least_bytes=10).collect())
    assert kinds == {"response": 7, "revisit": 1}
    assert archives.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    import gzip

    about = f"{version} 0 x\n{archives.ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else " 200 - - 0 f.arc"
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nline\n\nhttp://fake 1 2 3 4\n"
    plain = [b"filedesc://f 0.0.0.0 20010203040506 text/plain %d\n" % len(about) + about + b"\n",
             f"http://a/b c 1.2.3.4 20010203040506 text/html{more} {len(body)}\n".encode() + body + b"\n",
             f"dns:a 1.2.3.4 2001 text/dns{more} 3\n".encode() + b"abc\n"]
    for content in (b"".join(plain), b"".join(map(gzip.compress, plain)), gzip.compress(b"".join(plain))):
        records = list(archives.read_arc(content))
        assert [archives.warc_type(r) for r in records] == ["warcinfo", "response", "resource"]
        assert records[1].url == "http://a/b c" and records[1].block == body and records[2].block == b"abc"
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.warc_date("2001") == "2001-01-01T00:00:00Z"
    warc = next(archives.read_warc(archives.to_warc("f", 1, records[1], None) + b"\r\n\r\n"))
    assert warc.block == body and warc.fields["warc-type"] == "response" and warc.fields["warc-ip-address"] == "1.2.3.4"
    assert archives.to_warc("f", 1, records[1], None) == archives.to_warc("f", 1, records[1], None)
    assert list(archives.read_arc(b"")) == list(archives.read_arc(gzip.compress(b""))) == []
    for broken in (plain[1], b"".join(plain)[:-3], plain[0] + b"http://a 1 2 3 x\n"):
        with pytest.raises(archives.ArchiveError):
            list(archives.read_arc(broken))


# --- URL lists ------------------------------------------------------------------------------


def test_url_lists(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = spark.createDataFrame([
        ("example.com", day(10), "block"), ("example.com", day(200), "remove"), ("a.example.com", day(20), "allow"),
        ("a.example.com/x", day(30), "block"), ("tie.org", day(5), "allow"), ("tie.org", day(5), "block"), ("tie.org", day(5), "block"),
        (None, day(1), "block"), ("b.org", None, "block"), ("b.org", day(1), "what"),
    ], "key string, at timestamp, action string")
    captures = spark.createDataFrame([
        (1, "http://www.example.com/", day(9)), (2, "http://www.example.com/", day(10)), (3, "http://www.example.com/", day(200)),
        (4, "https://u@A.example.com:80/y?z", day(50)), (5, "http://a.example.com/x/y", day(50)), (6, "http://a.example.com/x", day(250)),
        (7, "http://tie.org./", day(5)), (8, None, day(50)), (9, "nonsense", day(50)), (10, "http://tie.org", None), (11, "http://b.org/", day(50)),
        (2, "http://www.example.com/", day(10)), (12, "http://notexample.com/", day(50)),
    ], "page_id long, url string, fetched_at timestamp").withColumn("verdict", F.lit("clash"))
    got = collections.Counter((r.page_id, r.n_active, r.verdict, r.rule) for r in url_lists.apply_lists(captures, entries).collect())
    assert got == collections.Counter([
        (1, 0, "none", None), (2, 1, "block", "example.com"), (2, 1, "block", "example.com"), (3, 0, "none", None),
        (4, 2, "allow", "a.example.com"), (5, 3, "block", "a.example.com/x"), (6, 2, "block", "a.example.com/x"),
        (7, 1, "block", "tie.org"), (8, 0, "none", None), (9, 0, "none", None), (10, 0, "none", None), (11, 0, "none", None), (12, 0, "none", None),
    ])
    assert url_lists.apply_lists(captures.limit(0), entries).count() == 0
    assert url_lists.apply_lists(captures, entries.limit(0)).where("n_active > 0").count() == 0


def test_long_keys_and_empty_segments(spark):
    at = dt.datetime(2024, 1, 1)
    long = ".".join(["label"] * 60)
    entries = spark.createDataFrame([("a.org/x/y/z", at, "block"), ("a.org/x", at, "allow"), (long, at, "block")], "key string, at timestamp, action string")
    captures = spark.createDataFrame([
        (1, "http://a.org/x/y/z/more", at), (2, "http://a.org//x//y/z", at), (3, "http://a.org/x/y", at), (4, f"http://{long}/", at),
        (5, f"http://sub.{long}/a/b", at),
    ], "page_id long, url string, fetched_at timestamp")
    got = {(r.page_id, r.n_active, r.verdict, r.rule) for r in url_lists.apply_lists(captures, entries).collect()}
    assert got == {(1, 2, "block", "a.org/x/y/z"), (2, 2, "block", "a.org/x/y/z"), (3, 1, "allow", "a.org/x"),
                   (4, 1, "block", long), (5, 1, "block", long)}


# --- packing --------------------------------------------------------------------------------


def test_ids_are_the_tokenizers(spark):
    rng = random.Random(6)
    ours = tokens.encoder(tokens.default_vocabulary())
    alphabet = "aBéßªİΣ \n\t́'.,$1²中😀s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(600)] + ["", "<|endoftext|> A", "  x  "]
    for _, ids, bounds in ours.encode_all(pa.array([*texts, None], pa.string())):
        for text, a, b in zip([*texts, ""], bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == ours.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 300]), 3000), "s") for i in range(150)]
    rows += [(200 + i, "same text", "s") for i in range(60)] + [(300, None, "s"), (None, "", "s"), (301, prose(rng, 900), "s"), (0, rows[0][1], "s")]
    reference = tokens.encoder(tokens.default_vocabulary()).tokenizer
    out = packing.pack_documents(docs(spark, rows), capacity=256).toPandas()
    want = collections.Counter()
    for i, text, _ in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[start:start + 256], dtype="<u4")
            want[-1 if i is None else i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    got = collections.Counter(zip(out.doc_id.fillna(-1).astype(int), out.piece, out.start, out.length, out.ids_crc32))
    assert got == want
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert (group.length.cumsum() - group.length == group.offset).all() and group.length.sum() <= 256
    assert out.sequence_id.nunique() <= best_fit(out.length, 256)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def best_fit(lengths, capacity):
    """Sequences of plain best-fit, longest first."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        place = bisect.bisect_left(rooms, length)
        room = rooms.pop(place) if place < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


def some_lengths(rng):
    """Lists of lengths of every kind; a few with little short to fill rooms with."""
    kinds = [
        lambda: rng.randint(1, 4096), lambda: rng.randint(1200, 2000), lambda: min(4096, max(1, int(rng.lognormvariate(6, 1)))),
        lambda: rng.choice([1366, 1365, 2049, 2047, 820, 1700]), lambda: rng.randint(257, 1400), lambda: rng.choice([4096, 1, 2, 3000]),
        lambda: rng.randint(900, 1500), lambda: rng.randint(1, 40),
    ]
    return [[kind() for _ in range(n)] for kind in kinds for n in (50, 1200)]


def test_plans_hold_every_piece_and_need_few_sequences():
    rng = random.Random(8)
    better = 0
    for lengths in ([100] * 5, [1], [4096, 4095, 1], [2049] * 7, [3000] * 400 + [1096] * 300, [], *some_lengths(rng)):
        histogram = collections.Counter(lengths)
        packed = collections.Counter()
        fillings = packing_plan.plan(histogram, 4096)
        for filling in fillings:
            assert sum(a * b for a, b in filling.items) <= 4096
            for length, many in filling.items:
                packed[length] += many * filling.copies
        assert packed == histogram
        needed, plain = sum(f.copies for f in fillings), best_fit(lengths, 4096)
        assert needed <= plain
        better += needed < plain
    assert better >= 3


def test_cover_and_its_bound():
    """The cover holds every class as often as it occurs; the bound is one of the dual program."""
    rng = random.Random(18)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(5, 100), 8)))
        counts = np.array([float(rng.randint(1, 30)) for _ in lengths])
        cover = packing_plan.fractional_cover(lengths, counts, 100)
        held = np.zeros(len(lengths))
        for configuration, use in cover.uses.items():
            assert use > 0 and sum(lengths[i] * k for i, k in configuration) <= 100
            for i, k in configuration:
                held[i] += use * k
        assert np.allclose(held, counts) and np.isclose(cover.value, sum(cover.uses.values()))
        plain = best_fit([int(x) for x, n in zip(lengths, counts) for _ in range(int(n))], 100)
        assert (lengths * counts).sum() / 100 - 1e-6 <= max(cover.bound, (lengths * counts).sum() / 100) <= cover.value + 1e-6
        assert cover.bound <= plain and cover.value <= 1.25 * cover.bound


def test_plan_of_the_test_documents(spark):
    cut = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    lengths = [r.length for r in cut.select("length").collect()]
    needed = sum(f.copies for f in packing_plan.plan(collections.Counter(lengths), 4096))
    assert needed == -(-sum(lengths) // 4096) == best_fit(lengths, 4096)


# --- secrets --------------------------------------------------------------------------------


def brute_base(text):
    spans = []
    for kind, pattern, least in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24),
    ):
        flags = re.I | re.A if kind == "assign" else 0
        for m in re.finditer(pattern, text or "", flags):
            if len(m[m.lastindex]) >= least:
                spans.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return sorted(spans)


def test_secrets(spark):
    rng = random.Random(9)
    parts = ["password=", "Secret : ", "api_key'=\"", "token", "=", "abc", "é😀", " ", "\n", "AKIA", "ABCD1234" * 2, "0123456789abcdef", "f" * 9, "token=short ", "x" * 150]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(150))]
    texts += texts[10:13]
    key, weak = "AKIA" + "Q" * 16, "aB3" + "dE5/" * 10
    texts += [f"{key} {weak}", weak, f"{key}{' ' * 300}{weak}", f"user: bob {weak}", "user: bob", f"see https://s3.example.com/x {key}", "https://example.com"]
    out = secret_scan.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = brute_base(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k, _ in spans) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
        assert {*filter(None, listed.split(","))} <= {*r.spans.split(",")}
    by_text = {texts[r.doc_id]: r.spans for r in out}
    assert f"secret:21:{21 + len(weak)}" in by_text[f"{key} {weak}"] and by_text[weak] == "" and by_text["user: bob"] == ""
    assert "secret" not in by_text[f"{key}{' ' * 300}{weak}"] and "user:0:9,secret" in by_text[f"user: bob {weak}"]
    assert "endpoint" in by_text[f"see https://s3.example.com/x {key}"] and by_text["https://example.com"] == ""
    assert secret_scan.scan(docs(spark, [])).count() == 0


# --- quality --------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 60) if i % 2 else "!! ".join(f"W{rng.randrange(99)}" for _ in range(60)), "s") for i in range(300)]
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "x", "s"), (1002, "y" * 50000, "s")]
    table = docs(spark, rows)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(300)] + [(1, 1), (None, 0), (2, None), (7777, 0)], "doc_id long, quality int")
    model = quality.fit(table, labels, per_class=60)
    assert len(model.labels) == 120
    out = quality.score_documents(table, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.ACCEPT) for r in out)
    judged = [r for r in out if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert judged and all(r.predicted == r.doc_id % 2 for r in judged)
    nothing = quality.score_documents(table, quality.fit(table, labels.limit(0)))
    assert {r.score for r in nothing.collect()} == {0.5}
    assert quality.score_documents(table.limit(0), model).count() == 0


def test_long_labelled_texts_get_their_scored_vectors(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % quality.HELD_OUT][:8]
    texts = ["ab" * 70000 + " some more text", *(prose(random.Random(i), 30) for i in ids[1:])]
    table = docs(spark, [(i, t, "s") for i, t in zip(ids, texts)])
    model = quality.fit(table, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    scored = np.concatenate([model.project(counts) for _, counts in quality._counts(pa.array(texts))])
    assert np.allclose(model.vectors, scored, atol=1e-4)


def test_scratch_is_shared(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_quality_counts_in_little_memory():
    texts = pa.array(["the quick brown fox " * 200_000, "", None, "é", "a"], pa.string())
    assert peak_mb(lambda: list(quality._counts(texts))) < 50


def test_quality_counts_across_steps(monkeypatch):
    monkeypatch.setattr(quality, "STEP_BYTES", 7)
    rng = random.Random(17)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("abé ") for _ in range(rng.randrange(30))) for _ in range(700)]
    got = np.concatenate([counts for _, counts in quality._counts(pa.array([*texts, "ab", "c"], pa.string()).slice(3))])
    assert len(got) == len(texts) - 1
    for text, counts in zip([*texts[3:], "ab", "c"], got):
        data = (text or "").encode()
        want = collections.Counter(int(quality._TERM[a << 8 | b]) for a, b in zip(data, data[1:]))
        assert {t: int(counts[t]) for t in np.flatnonzero(counts)} == want


def test_tokens_in_little_memory():
    rng = random.Random(18)
    texts = pa.array([prose(rng, 1000, 300) for _ in range(1700)], pa.string())
    ours = tokens.WordEncoder(tokens.default_vocabulary())
    total = 0

    def work():
        nonlocal total
        for _, ids, bounds in ours.encode_all(texts):
            total += len(bounds) - 1
            del ids

    assert peak_mb(work) < 60
    assert total == len(texts)
