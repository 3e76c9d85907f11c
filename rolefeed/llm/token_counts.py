"""Token counts that follow edits.

A document's pre-tokens are kept in a segment tree: leaves hold runs of pre-tokens, every node the
sum of characters and of tokens below it. An edit finds its place in the tree, cuts and counts
again from the last pre-token that it cannot reach, and stops where the new cuts meet the old
ones. Leaves in between are replaced and the sums above them updated; nothing else is read.

The pre-tokenizer cuts from left to right and looks at most one character beyond a pre-token and
the white space before that, so a pre-token that ends two characters before the edit is safe, and
once a new cut falls on an old one behind the edit, all later cuts are the old ones.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefeed.llm.rows import add_columns
from rolefeed.llm.tokens import Store

LEAF = 64  # pre-tokens in a leaf; one that grows beyond four times as many is divided

TREE = "tree struct<lengths:binary,counts:binary>, n_pretokens bigint, n_tokens bigint"
EDITS = "array<struct<start:bigint,stop:bigint,insert:string>>"


class Counter:
    """Cuts text into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts = Store(lambda piece: len(self.encoding.encode_ordinary(piece)))

    def count(self, text: str) -> tuple[array, array]:
        """Lengths and token counts of a text's pre-tokens."""
        found = self.pattern.findall(text)
        out = array("I", map(len, found)), array("I", map(self.counts.__getitem__, found))
        self.counts.tidy()
        return out


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Tree:
    """Pre-tokens of one text. ``sums[1]`` is the root; node ``i`` has children ``2i, 2i + 1``."""

    def __init__(self, lengths, counts):
        self._build(np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64))

    def _build(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        heads = np.arange(0, len(lengths), LEAF)
        self.leaves = [(lengths[i:i + LEAF], counts[i:i + LEAF]) for i in heads] or [(lengths, counts)]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        for at, (a, b) in enumerate(self.leaves):
            self.sums[self.size + at] = a.sum(), b.sum()
        for node in range(self.size - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([leaf[i] for leaf in self.leaves]) for i in (0, 1))

    def find(self, char: int) -> tuple[int, int, int]:
        """The pre-token that holds a character: leaf, place in the leaf, where it begins. Past
        the end: behind the last one."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.sums[node, 0] <= char and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        leaf = node - self.size
        ends = before + np.cumsum(self.leaves[leaf][0])
        place = int(np.searchsorted(ends, char, side="right"))
        return leaf, place, int(ends[place - 1]) if place else before

    def _lengths_from(self, leaf: int, place: int):
        while leaf < len(self.leaves):
            lengths = self.leaves[leaf][0]
            for i in range(place, len(lengths)):
                yield leaf, i, int(lengths[i])
            leaf, place = leaf + 1, 0

    def edit(self, text: str, start: int, stop: int, insert: str, counted: Counter) -> tuple[str, int]:
        """Replace ``text[start:stop]``: the new text and how many characters were counted again."""
        size = len(text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        text = text[:start] + insert + text[stop:]
        moved = len(insert) - (stop - start)
        first, place, at = self.find(max(start - 2, 0)) if size else (0, 0, 0)
        old = self._lengths_from(first, place)
        old_end, last, after = at, first, place  # old pre-tokens before (last, after) are replaced
        pieces, pos = [], at
        for match in counted.pattern.finditer(text, at):
            pieces.append(match.group())
            pos = match.end()
            if pos >= start + len(insert):
                while old_end < pos - moved or old_end < stop:
                    step = next(old, None)
                    if step is None:
                        break
                    last, after, old_end = step[0], step[1] + 1, old_end + step[2]
                if old_end == pos - moved and old_end >= stop:
                    break
        else:  # to the end of the text
            last, after = len(self.leaves) - 1, len(self.leaves[-1][0])
        new = (np.array([len(p) for p in pieces], dtype=np.int64),
               np.array([counted.counts[p] for p in pieces], dtype=np.int64))
        self._replace(first, place, last, after, new)
        return text, pos - at

    def _replace(self, first: int, place: int, last: int, after: int, new) -> None:
        left, right = self.leaves[first], self.leaves[last]
        self.leaves[first] = tuple(np.concatenate([left[i][:place], new[i], right[i][after:]]) for i in (0, 1))
        for leaf in range(first + 1, last + 1):
            self.leaves[leaf] = (left[0][:0], left[1][:0])
        if len(self.leaves[first][0]) > 4 * LEAF:
            self._build(*self.flat())
            return
        changed = set()
        for leaf in range(first, last + 1):
            self.sums[self.size + leaf] = self.leaves[leaf][0].sum(), self.leaves[leaf][1].sum()
            changed.add((self.size + leaf) // 2)
        while changed and 0 not in changed:
            for node in changed:
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            changed = {node // 2 for node in changed}


def _tree_rows(trees: list[Tree | None]) -> list[pa.Array]:
    rows, n_pre, n_tok = [], [], []
    for tree in trees:
        lengths, counts = tree.flat()
        rows.append({"lengths": lengths.astype("<u4").tobytes(), "counts": counts.astype("<u4").tobytes()})
        n_pre.append(len(lengths))
        n_tok.append(tree.n_tokens)
    kind = pa.struct([("lengths", pa.binary()), ("counts", pa.binary())])
    return [pa.array(rows, kind), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())]


def build_trees(docs: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``tree`` (its leaves' values; the sums above them are made when it is read),
    ``n_pretokens`` and ``n_tokens``. A NULL text counts as empty."""
    names = vocabulary or default_vocabulary()

    def run(arrays):
        rows, n_pre, n_tok = [], [], []
        for t in arrays[0]:
            lengths, counts = counter(*names).count(t.as_py() or "")
            rows.append({"lengths": lengths.tobytes(), "counts": counts.tobytes()})
            n_pre.append(len(lengths))
            n_tok.append(sum(counts))
        kind = pa.struct([("lengths", pa.binary()), ("counts", pa.binary())])
        return [pa.array(rows, kind), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())]

    return add_columns(docs, [docs[text].cast("string")], TREE, run)


def apply_edits(trees: DataFrame, edits: str = "edits", text: str = "text",
                vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``trees`` (from ``build_trees``) after each document's ``edits``, an array of (start, stop,
    insert) in characters, applied in turn: new ``text``, ``tree``, ``n_pretokens``, ``n_tokens``, and
    ``n_recounted``, the characters that were cut and counted again.

    Places beyond the text mean its end, a NULL place 0, a NULL insert nothing, NULL edits none.
    """
    names = vocabulary or default_vocabulary()

    def run(arrays):
        texts, done, recounted = [], [], []
        for t, tree, changes in zip(arrays[0], arrays[1], arrays[2]):
            body, values = t.as_py(), tree.as_py()
            one = Tree(np.frombuffer(values["lengths"], "<u4"), np.frombuffer(values["counts"], "<u4"))
            total = 0
            for e in changes.as_py() or []:
                if e is not None:
                    start = e["start"] or 0
                    body, n = one.edit(body or "", start, e["stop"] if e["stop"] is not None else start,
                                       e["insert"] or "", counter(*names))
                    total += n
            texts.append(body)
            done.append(one)
            recounted.append(total)
        return [pa.array(texts, pa.string()), *_tree_rows(done), pa.array(recounted, pa.int64())]

    return add_columns(
        trees, [trees[text].cast("string"), trees["tree"], trees[edits].cast(EDITS)],
        f"{text} string, {TREE}, n_recounted bigint", run,
    )


def collected_edits(edits: DataFrame, doc_id: str = "doc_id", order: str = "seq") -> DataFrame:
    """A log of edits (``doc_id, seq, start, stop, insert``) as one array per document, in order,
    to be joined with the trees. A document's edits build on each other, so they go together; cut
    the log into rounds if one document's edits are more than a task holds."""
    one = F.struct(F.col(order).alias("seq"), "start", "stop", "insert")
    return edits.groupBy(doc_id).agg(F.sort_array(F.collect_list(one)).alias("all")).select(
        doc_id, F.transform("all", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["insert"].alias("insert"))).alias("edits")
    )
