"""Operator 11, fill-in-middle: a text is cut at two token borders and its parts are put in another order.

A unit (token) is a run of A-Z, a-z or any other single code point.  The UTF-8 bytes of a text are
looked at in blocks of ``BLOCK`` bytes; a Fenwick tree over the blocks stores how many units and
how many code points begin in each.  A cut after ``k`` units is found by descending the tree in
powers of two to the block in which unit ``k`` begins; the border is then located inside that block
only, and its code points are those before the block plus those in the block's first bytes.

Cut places and form come from the sha256 of ``<key><doc_id>``, so a row gives the same output on any
executor or attempt.  ``restore`` is the decoder: column expressions that rebuild the text from
output and form alone.  No marker overlaps another one or itself, and texts that hold a marker stay
plain, so the three markers found in an output are those put there.

Null and empty texts are plain, with no units and empty output; a null doc_id hashes the bare key;
repeated rows get equal results; an empty table gives an empty result.  ``fill_in_middle`` keeps all
columns and adds one struct; a column of that name is replaced.  Memory: Arrow batches are bounded by
Spark in rows and bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), a longer text comes alone, and
a text needs some ten times its bytes while it is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
# Markers of the parts, share of texts left plain and of the rest with the suffix first, and
# what comes before the doc_id in the hash.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
KEY = "1:"

FIELDS = ["n", "form", "prefix_chars", "middle_chars", "output"]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


class BlockTree:
    """Fenwick tree over blocks of UTF-8 bytes with the units and code points that begin in each."""

    def __init__(self, data: bytes, block: int = BLOCK):
        b = np.frombuffer(data, np.uint8)
        letter = ((b | 0x20) >= ord("a")) & ((b | 0x20) <= ord("z"))
        self.chars = (b & 0xC0) != 0x80
        self.units = self.chars & ~letter
        # a letter begins a unit unless a letter stands before it
        self.units[:1] |= letter[:1]
        self.units[1:] |= letter[1:] & ~letter[:-1]
        self.block, self.size = block, len(b)
        edges = np.arange(0, len(b), block)
        self.blocks = len(edges)
        self.tree = np.zeros((self.blocks + 1, 2), np.int64)
        if self.blocks:
            self.tree[1:, 0] = np.add.reduceat(self.units, edges, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(self.chars, edges, dtype=np.int64)
        self.n_units, self.n_chars = (int(x) for x in self.tree.sum(axis=0))
        for i in range(1, self.blocks + 1):  # each node passes its sum to its parent
            parent = i + (i & -i)
            if parent <= self.blocks:
                self.tree[parent] += self.tree[i]

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which unit ``k`` begins; the end of the text for k = n_units."""
        if k >= self.n_units:
            return self.size, self.n_chars
        at, units, chars = 0, 0, 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            if at + step <= self.blocks and units + self.tree[at + step, 0] <= k:
                at += step
                units += int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
            step >>= 1
        first = at * self.block
        inside = np.flatnonzero(self.units[first : first + self.block])[k - units]
        return first + int(inside), chars + int(np.count_nonzero(self.chars[first : first + inside]))


def cut_text(doc_id: str | None, data: bytes, key: str = KEY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    tree = BlockTree(data)
    digest = hashlib.sha256((key + (doc_id or "")).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or h3 % 100 >= PLAIN_FROM or p in data or s in data or m in data:
        return tree.n_units, "plain", None, None, data
    places = sorted((h1 % (tree.n_units + 1), h2 % (tree.n_units + 1)))
    (a, a_chars), (b, b_chars) = tree.cut(places[0]), tree.cut(places[1])
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SPM_BELOW:
        form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return tree.n_units, form, a_chars, b_chars - a_chars, output


def _cutter(key: str):
    @F.arrow_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in parts:
            pairs = zip(ids.to_pylist(), texts, strict=True)
            rows = [cut_text(i, t.as_py() or b"", key) for i, t in pairs]
            columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], FIELDS)

    return cut


def fill_in_middle(docs: DataFrame, into: str = "fim", key: str = KEY) -> DataFrame:
    """``docs`` with the struct ``into``: n, form, prefix_chars, middle_chars, output (a string)."""
    out = _cutter(key)(F.col("doc_id").cast("string"), F.col("text").cast("binary"))
    cut = docs.withColumn(into, out)
    return cut.withColumn(into, F.col(into).withField("output", F.col(into)["output"].cast("string")))


def restore(output: Column, form: Column) -> Column:
    """The text from output and form."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
        .otherwise(F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))
    )


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    cut = fill_in_middle(docs.select("doc_id", "text"))
    fim = F.col("fim")
    return cut.select(
        "doc_id",
        *[fim[c].alias(c) for c in FIELDS[:-1]],
        F.sha2(fim["output"].cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(fim["output"], fim["form"]).cast("binary"), 256).alias("restored_sha256"),
    )
