"""Operator 13, ranked lexical search: documents that no item can tell apart are scored once, as a class.

1. *Restrict.*  Every whole text is cut into terms; a document keeps its term count ``n`` and the (term,
   tf) pairs of terms that occur in some item, as one array ordered by term.  Rows stay where they are read.
2. *Statistics.*  Documents, terms and document frequencies are counted over all rows; they give each
   document its length factor ``m`` and each term its weight.
3. *Classes.*  A score depends on the restricted vector and ``m`` alone.  Rows are dealt by a hash of both
   and grouped by hash, ``m`` and the whole vector, so two different vectors with one hash stay two classes
   (the verification).  Of a class the ``top`` least doc_ids are kept, by a window whose limit already
   applies before the shuffle: a class with a third of all rows sends ``top`` rows a task.
4. *Scores.*  Classes meet the items' posting lists in batches, where each (class, term) pair adds to
   the items that hold the term, in 64-bit integers.  A task keeps the ``top`` classes of each item by score, then
   least doc_id; of equal scores a class beyond these has ``top`` smaller doc_ids before it, so nothing is lost.
5. *Expand.*  The classes' members are ranked per item by score, then doc_id.

Items are the stated query set: they are dealt into blocks of about ``BLOCK_BYTES`` of text, each block with its
own vocabulary and posting lists in the tasks, and the documents are gone through once for each block.

Null and empty texts have no terms (as items: no rows); equal benchmark rows are one item, rows of one item_id with
different texts are ranked apart; repeated documents are ranked each; null doc_ids come last among equal scores;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.common import written

TOP = 20
BLOCK_BYTES = 4 << 20  # item texts of one block
CHUNK = 1 << 20  # bytes of a text that are cut into terms at a time
PAIRS = 1 << 21  # (class, item) additions made at a time
CELLS = 1 << 22  # scores of (class, item) held at a time
# Terms are runs of ASCII letters and digits and of all other letters beyond ASCII; the constants
# of the score.
SCALE, TF_SCALE, M_SCALE = 1_000_000_000, 1000, 12
M_BASE, M_SLOPE = 75, 25

_FOLD = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else 0x20 for i in range(256)
)
VECTOR = "array<struct<t: int, tf: bigint>>"
_VECTOR = pa.list_(pa.struct([("t", pa.int32()), ("tf", pa.int64())]))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, some at a time; only A-Z are lower-cased."""
    folded = data.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def restrict(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and vec (terms of ``vocabulary`` with their tf, by term number) of every document."""

    @F.arrow_udf(f"n bigint, vec {VECTOR}")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            sizes, vectors = [], []
            for text in texts:
                n, found = 0, Counter()
                for some in terms(text.as_py() or b""):
                    n += len(some)
                    found.update(filter(vocabulary.__contains__, some))
                sizes.append(n)
                vectors.append([{"t": t, "tf": tf} for t, tf in sorted((vocabulary[w], tf) for w, tf in found.items())])
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(vectors, _VECTOR)], ["n", "vec"])

    cut_rows = docs.select("doc_id", cut(F.col("text").cast("binary")).alias("cut"))
    return cut_rows.select("doc_id", "cut.n", "cut.vec")


def classes(restricted: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """One row per class: m, vec and members (its ``top`` least doc_ids in order, nulls last)."""
    m = F.lit(M_BASE) + F.expr(f"(CAST({M_SLOPE} AS BIGINT) * n * {n_docs}L) DIV {max(n_terms, 1)}L")
    keyed = restricted.where(F.size("vec") > 0).select("doc_id", m.alias("m"), "vec")
    keyed = keyed.withColumn("h", F.xxhash64("m", "vec"))
    place = F.row_number().over(Window.partitionBy("h", "m", "vec").orderBy(F.asc_nulls_last("doc_id")))
    least = keyed.withColumn("place", place).where(F.col("place") <= top)
    members = F.array_sort(F.collect_list(F.struct("place", "doc_id")))  # at most ``top``
    grouped = least.groupBy("h", "m", "vec").agg(members.alias("members"))
    return grouped.select("m", "vec", F.col("members.doc_id").alias("members"))


class Postings:
    """Items of each term, with weight times occurrences in the item."""

    def __init__(self, vocabulary: dict[bytes, int], items: list[Counter], weights: list[int]):
        held = sorted((vocabulary[w], i, c * weights[vocabulary[w]]) for i, ws in enumerate(items) for w, c in ws.items())
        self.items = np.array([i for _, i, _ in held], np.int32)
        self.gains = np.array([g for _, _, g in held], np.int64)
        sizes = np.bincount([t for t, _, _ in held], minlength=len(vocabulary))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.n_items = len(items)

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        """(rows x items) sums of impact times gain over the (row, term) pairs."""
        out = np.zeros(rows * self.n_items, np.int64)
        size = self.first[term + 1] - self.first[term]
        done = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
            k = size[at:to]
            pair = np.repeat(np.arange(at, to), k)
            posting = np.arange(k.sum()) - np.repeat(done[at:to] - done[at], k) + self.first[term[pair]]
            np.add.at(out, row[pair] * self.n_items + self.items[posting], impact[pair] * self.gains[posting])
            at = to
        return out.reshape(rows, self.n_items)


class Best:
    """The ``top`` classes of each item so far, by score, then least doc_id."""

    def __init__(self, n_items: int, top: int):
        self.top, self.rows = top, [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, np.int64)  # a lower score cannot get in

    def add(self, scores: np.ndarray, members: list[list]) -> None:
        at, item = np.nonzero(scores >= self.floor)
        for i in np.unique(item):
            new = at[item == i]
            rows = self.rows[i] + [(-int(scores[r, i]), members[r][0] is None, members[r][0] or 0, members[r]) for r in new]
            rows.sort(key=lambda x: x[:3])
            self.rows[i] = rows[: self.top]
            if len(rows) >= self.top:
                self.floor[i] = -self.rows[i][-1][0]


def _batches(part: pa.RecordBatch, n_items: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // n_items)
    for at in range(0, part.num_rows, step):
        yield part.slice(at, step)


def best_classes(found: DataFrame, postings: Postings, top: int) -> DataFrame:
    """item (its number), score and members of the classes that may be among an item's first ``top``."""
    id_type = found.schema["members"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(postings.n_items, top)
        members_type = None
        for whole in parts:
            members_type = whole.schema.field("members").type
            for part in _batches(whole, postings.n_items):
                vectors = part.column("vec")
                row = np.repeat(np.arange(part.num_rows), vectors.value_lengths().to_numpy())
                flat = vectors.flatten()
                term, tf = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                m = part.column("m").to_numpy()[row]
                impact = SCALE * tf // (TF_SCALE * tf + M_SCALE * m)
                best.add(postings.scores(row, term, impact, part.num_rows), part.column("members").to_pylist())
        rows = [(i, -r[0], r[3]) for i, kept in enumerate(best.rows) for r in kept]
        if rows:
            item, score, members = zip(*rows, strict=True)
            arrays = [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(members, members_type)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "score", "members"])

    return found.mapInArrow(run, f"item int, score bigint, members {id_type}")


def _rank_block(docs: DataFrame, block: list, top: int) -> DataFrame:
    """item, rank, doc_id, score for the items of one block: (item_id, text as UTF-8) rows."""
    items = [Counter(w for some in terms(text) for w in some) for _, text in block]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*items)))}
    restricted = written(restrict(docs, vocabulary), "ranking")
    n_docs, n_terms = restricted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = restricted.select(F.explode("vec.t").alias("t")).groupBy("t").count()
    frequency = dict(df.collect())  # at most one row per term of the block
    weights = [
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(vocabulary))
    ]
    found = classes(restricted, n_docs, n_terms, top)
    best = best_classes(found, Postings(vocabulary, items, weights), top)
    expanded = best.select("item", "score", F.explode("members").alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    asked = asked.where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n_blocks, 1)))
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not docs.schema["doc_id"].dataType.simpleString() == "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    for b in range(n_blocks):
        rows = asked.where(block == b).collect()  # about ``block_bytes``
        rows = [(r["item_id"], bytes(r["text"])) for r in rows]
        if any(some for _, text in rows for some in terms(text)):
            out = out.unionByName(_rank_block(docs, rows, top))
    return out
