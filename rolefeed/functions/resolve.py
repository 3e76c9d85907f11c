"""Addresses resolved against the page they stand on, as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The schemes whose addresses may be relative, and those of them whose last path
# segment may carry parameters. No scheme counts as one.
RELATIVE = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
WITH_PARAMETERS = (
    "", "ftp", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "mms", "sftp",
)

# The five parts of an address: scheme, authority, path, query, fragment.
_PARTS = r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def _let(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), function)[0]


@functools.cache
def _ipv6() -> str:
    """A bracketed host that is an IPv6 address, with a zone or not, or of a future version."""
    h, octet = "[0-9a-fA-F]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    last = rf"(?:{h}:{h}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{last}"]
    for before in range(6):
        left = f"(?:(?:{h}:){{0,{before - 1}}}{h})?" if before else ""
        forms.append(f"{left}::(?:{h}:){{{5 - before}}}{last}")
    forms += [f"(?:(?:{h}:){{0,5}}{h})?::{h}", f"(?:(?:{h}:){{0,6}}{h})?::"]
    return rf"\A(?:(?:{'|'.join(forms)})(?:%[^%]+)?|v[a-fA-F0-9]+\..+)\z"


@functools.cache
def _lookalikes() -> str:
    """Characters that normalise to something with a delimiter in it."""
    found = [
        c for c in map(chr, range(128, sys.maxunicode + 1))
        if any(d in unicodedata.normalize("NFKC", c) for d in "/?#@:")
    ]
    return "[" + "".join(found) + "]"


def _parsed(address: Column, scheme: Column) -> Column:
    """The parts of an address, ``scheme`` being what it inherits, and whether it is valid."""
    def split(text: Column) -> Column:
        own, authority, path, query, fragment = (F.regexp_extract(text, _PARTS, i) for i in range(1, 6))
        return F.struct(
            F.when(own == "", scheme).otherwise(F.lower(own)).alias("scheme"), authority.alias("authority"),
            path.alias("path"), query.alias("query"), fragment.alias("fragment"),
        )

    def checked(parts: Column) -> Column:
        authority, path = parts["authority"], parts["path"]
        opened, closed = authority.contains("["), authority.contains("]")
        host = F.regexp_extract(authority, r"(?s)\A[^\[]*\[([^\]]*)", 1)
        valid = (opened == closed) & (~opened | host.rlike(_ipv6())) & ~authority.rlike(_lookalikes())
        # Parameters follow the first semicolon of the last segment.
        cut = F.regexp_extract(path, r"(?s)\A((?:.*/)?[^/;]*);[^/]*\z", 1)
        has = parts["scheme"].isin(*WITH_PARAMETERS) & path.rlike(r"(?s);[^/]*\z")
        return F.struct(
            valid.alias("valid"), parts["scheme"].alias("scheme"), authority.alias("authority"),
            F.when(has, cut).otherwise(path).alias("path"),
            F.when(has, F.substr(path, F.length(cut) + 2)).otherwise("").alias("parameters"),
            parts["query"].alias("query"), parts["fragment"].alias("fragment"),
        )

    # Control characters and blanks before an address do not count, line ends inside it neither.
    text = F.translate(F.regexp_replace(address, r"\A[\x00-\x20]+", ""), "\t\r\n", "")
    return _let(_let(text, split), checked)


def _put_together(scheme: Column, authority: Column, path: Column, parameters: Column, query: Column, fragment: Column) -> Column:
    def written(rest: Column) -> Column:
        rooted = F.when((rest != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest)
        bare = rest.startswith("//") | ((scheme != "") & ((rest == "") | rest.startswith("/")))
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(authority != "", F.concat(F.lit("//"), authority, rooted))
            .when(bare, F.concat(F.lit("//"), rest)).otherwise(rest),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
            F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
        )

    return _let(F.concat(path, F.when(parameters != "", F.concat(F.lit(";"), parameters)).otherwise("")), written)


def _merged(base_path: Column, path: Column) -> Column:
    """The path of a relative address under that of its base, without dot segments."""
    # What follows the last slash of the base is no folder.
    above = _let(F.split(base_path, "/", -1), lambda p: F.when(
        F.element_at(p, -1) == "", p).otherwise(F.slice(p, F.lit(1), F.size(p) - 1)))

    def compact(segments: Column) -> Column:
        size = F.size(segments)
        middle = F.filter(F.slice(segments, F.lit(2), F.greatest(size - 2, F.lit(0))), lambda s: s != "")
        return F.when(size < 3, segments).otherwise(F.concat(F.slice(segments, 1, 1), middle, F.slice(segments, -1, 1)))

    def resolved(segments: Column) -> Column:
        def step(done: Column, segment: Column) -> Column:
            up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

        done = F.aggregate(segments, F.array().cast("array<string>"), step)
        dotted = F.element_at(segments, -1).isin(".", "..")
        whole = F.array_join(F.when(dotted, F.concat(done, F.array(F.lit("")))).otherwise(done), "/")
        return _let(whole, lambda p: F.when(p == "", "/").otherwise(p))

    own = F.split(path, "/", -1)
    below = _let(F.concat(above, own), compact)
    return _let(F.when(path.startswith("/"), own).otherwise(below), resolved)


def resolved(base: Column, address: Column) -> Column:
    """``address`` as it reads on the page ``base`` (RFC 3986, in Python's reading of it). An address
    of another scheme, or of one that has no relative form, stays as written. NULL if either cannot
    be parsed, or if the address is NULL; a NULL base counts as empty.
    """
    def against(parts: Column) -> Column:
        b, a = parts["b"], parts["a"]
        empty = (a["path"] == "") & (a["parameters"] == "")
        inherited = _put_together(
            a["scheme"], b["authority"], b["path"], b["parameters"],
            F.when(a["query"] == "", b["query"]).otherwise(a["query"]), a["fragment"],
        )
        below = _put_together(
            a["scheme"], b["authority"], _merged(b["path"], a["path"]), a["parameters"], a["query"], a["fragment"])
        whole = _put_together(a["scheme"], a["authority"], a["path"], a["parameters"], a["query"], a["fragment"])
        return (
            F.when(~b["valid"] | ~a["valid"], F.lit(None).cast("string"))
            .when((a["scheme"] != b["scheme"]) | ~a["scheme"].isin(*RELATIVE), parts["written"])
            .when(a["authority"] != "", whole).when(empty, inherited).otherwise(below)
        )

    page = F.coalesce(base, F.lit(""))
    parts = _let(_parsed(page, F.lit("")), lambda b: F.struct(
        b.alias("b"), _parsed(address, b["scheme"]).alias("a"), address.alias("written")))
    return F.when(page == "", address).when(address == "", page).otherwise(_let(parts, against))
