"""Operators 2 and 10: the piece lattice of a sentence-piece vocabulary, sampled and counted.

A vocabulary is a list of (piece, score, id), read from a tokenizer file whose path is a
parameter; spaces are written as U+2581 in it.  A text is cut before every run of U+2581 (no
piece has one after another letter, which loading checks), so each cut token has a lattice of its
own and equal tokens of a batch share it.  ``Lattice`` enumerates the pieces of all distinct
tokens of a batch with one Aho-Corasick automaton, letter by letter for all tokens at once;
the letters' own pieces (or byte pieces, for letters without one) come last.

Operator 10 runs the best-score recursion over it and keeps the piece count only.  Its tie rule
is the unigram tokenizers': a later, shorter piece must score more to replace an earlier one.  An
unknown letter scores 10 under the least score and counts its UTF-8 bytes.

Operator 2 runs the forward sums of exp(alpha * score) over the same lattice and samples backward:
the segmentation has exactly the probability of its weight among all segmentations.  The random
numbers are a hash of (seed, row key, token, step), so a row gives the same pieces on any
executor, partitioning or attempt.  U+2581 in a text is encoded by its bytes, so decoding gives
the text back; the operator decodes every row and raises if one byte differs.

Memory: rows are handled in batches of at most ``BATCH_CHARS`` letters (a longer text alone);
nothing is kept between batches.  Null and empty texts have no pieces; null row keys are a key like
any other; repeated rows get equal results; empty tables give empty results; columns other than the
key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 1_000_000
ROWS_AT_ONCE = 256
ALPHA = 1e-4
UNKNOWN_PENALTY = 10
BAR = 0x2581
MARK = 0x110000  # no code point: stands for U+2581 itself where the two must differ
N_CODES = 0x110001
_U = np.uint64


class Vocabulary:
    """Pieces with scores and ids; byte_ids: the 256 ids of the byte pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        bar = chr(BAR)
        for p, _, _ in pieces:
            if bar in p.lstrip(bar):
                raise ValueError(f"piece {p!r} has a space after a letter")
        self.pieces, self.byte_ids = pieces, byte_ids

    @staticmethod
    def load(path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        pieces = [(m.id_to_piece(i), m.get_score(i), i) for i in ids if not special(i)]
        byte_of = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        return Vocabulary(pieces, [byte_of[f"<0x{b:02X}>"] for b in range(256)])


class Lattice:
    """The Aho-Corasick automaton of a vocabulary's longer pieces, as arrays."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        longer = [(p, s, i) for p, s, i in vocab.pieces if len(p) > 1]
        letters = sorted({ord(c) for p, _, _ in longer for c in p})
        self.classes = np.zeros(N_CODES, np.uint16)  # 0: in no longer piece
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.single_id = np.full(N_CODES, -1, np.int32)
        least = min(s for _, s, _ in vocab.pieces)
        self.single_score = np.full(N_CODES, least - UNKNOWN_PENALTY, np.float64)
        for p, s, i in vocab.pieces:
            if len(p) == 1:
                self.single_id[ord(p)], self.single_score[ord(p)] = i, s
        codes = np.arange(N_CODES)
        self.n_bytes = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.uint8)
        children: list[dict[int, int]] = [{}]
        out_id = [-1]
        out_score = [0.0]
        depth = [0]
        for p, s, i in longer:
            at = 0
            for c in p:
                k = int(self.classes[ord(c)])
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    out_id.append(-1)
                    out_score.append(0.0)
                    depth.append(depth[at] + 1)
                at = children[at][k]
            out_id[at], out_score[at] = i, s
        n = len(children)
        self.go = np.zeros((n, len(letters) + 1), np.uint16 if n < 1 << 16 else np.int32)
        fail = [0] * n
        self.out_link = np.zeros(n, np.int32)  # next shorter piece that ends here, 0: none
        order = [0]
        for at in order:
            row = self.go[at]
            if at:
                row[:] = self.go[fail[at]]
                f = fail[at]
                self.out_link[at] = f if out_id[f] >= 0 else self.out_link[f]
            for k, child in children[at].items():
                fail[child] = int(row[k]) if at else 0
                row[k] = child
                order.append(child)
        self.piece_id = np.array(out_id, np.int32)
        self.piece_score = np.array(out_score, np.float64)
        self.piece_len = np.array(depth, np.int32)
        # state -> its longest piece's state (0: none)
        self.first_out = np.where(self.piece_id >= 0, np.arange(n), self.out_link).astype(np.int32)

    def steps(self, cps: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Iterator[tuple]:
        """For each letter place j of the tokens (longest first): (j, tokens, letters, outputs);
        outputs yields (index into tokens, state of a piece ending here), longest pieces first."""
        state = np.zeros(len(starts), np.int32)
        alive = len(starts)
        ends = np.sort(lens)
        for j in range(int(lens[0]) if len(lens) else 0):
            alive = len(lens) - int(np.searchsorted(ends, j, side="right"))
            letters = cps[starts[:alive] + j]
            state[:alive] = self.go[state[:alive], self.classes[letters]]
            yield j, alive, letters, self._outputs(state[:alive])

    def _outputs(self, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        out = self.first_out[state]
        at = np.flatnonzero(out)
        out = out[at]
        while len(at):
            yield at, out
            out = self.out_link[out]
            more = out != 0
            at, out = at[more], out[more]


@lru_cache(maxsize=1)
def _lattice(vocab_key: int, get) -> Lattice:  # one automaton a worker
    return Lattice(get())


class _Shared:
    """The broadcast vocabulary and the automaton that a worker builds from it once."""

    def __init__(self, spark, vocab: Vocabulary):
        self.key = zlib.crc32(repr(vocab.pieces).encode())
        self.var = spark.sparkContext.broadcast(vocab)

    def __hash__(self) -> int:
        return self.key

    def __eq__(self, other) -> bool:
        return self.key == other.key

    def __call__(self) -> Vocabulary:
        return self.var.value

    def lattice(self) -> Lattice:
        return _lattice(self.key, self)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def cut(texts: list[str], prefix: bool, mark: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, spaces as U+2581, and for each token its start, length and text index.

    mark: U+2581 itself becomes ``MARK``, so that it can be told from a space.  Every text begins
    a token.
    """
    parts = [" " + t if t else "" for t in texts] if prefix else texts
    cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if mark:
        cps[cps == BAR] = MARK
    cps[cps == 0x20] = BAR
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    first = np.cumsum(sizes) - sizes
    bar = cps == BAR
    begins = bar.copy()
    begins[1:] &= ~bar[:-1]
    begins[first[sizes > 0]] = True
    starts = np.flatnonzero(begins)
    lens = np.diff(np.append(starts, len(cps)))
    owner = np.searchsorted(first + sizes, starts, side="right")
    return cps, starts, lens, owner


def distinct_tokens(cps: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a first example, index into it for every token), the longest tokens first.

    Tokens agree if length and a 64-bit sum of position-keyed letter hashes agree.
    """
    place = np.arange(len(cps), dtype=np.int64) - np.repeat(starts, lens)
    h = _mix((cps.astype(np.uint64) << _U(32)) + place.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    key = np.add.reduceat(h, starts) if len(starts) else np.zeros(0, np.uint64)
    _, example, inverse = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(-lens[example], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return example[order], rank[inverse]


def _actual(cps: np.ndarray) -> np.ndarray:
    """The mark has no piece of its own; its bytes are those of U+2581."""
    return np.where(cps == MARK, BAR, cps)


def count_pieces(lat: Lattice, texts: list[str], prefix: bool = True) -> np.ndarray:
    """Pieces of the best-scoring segmentation of each text."""
    cps, starts, lens, owner = cut(texts, prefix, mark=False)
    example, which = distinct_tokens(cps, starts, lens)
    st, ln = starts[example], lens[example]
    base = np.cumsum(ln + 1) - (ln + 1)
    best = np.full(int((ln + 1).sum()), -np.inf)
    count = np.zeros(len(best), np.int64)
    best[base] = 0.0
    for j, alive, letters, outputs in lat.steps(cps, st, ln):
        end = base[:alive] + j + 1
        top, n = np.full(alive, -np.inf), np.zeros(alive, np.int64)
        for at, out in outputs:
            back = end[at] - lat.piece_len[out]
            score = best[back] + lat.piece_score[out]
            better = score > top[at]
            at = at[better]
            top[at], n[at] = score[better], count[back[better]] + 1
        score = best[end - 1] + lat.single_score[letters]
        better = score > top
        own = np.where(lat.single_id[letters] >= 0, 1, lat.n_bytes[letters])
        best[end] = np.where(better, score, top)
        count[end] = np.where(better, count[end - 1] + own, n)
    total = count[base + ln]
    return np.bincount(owner, weights=total[which], minlength=len(texts)).astype(np.int64)


def sample_pieces(
    lat: Lattice, texts: list[str], keys: np.ndarray, alpha: float = ALPHA, prefix: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, number of ids of each text), one sampled segmentation a text.

    keys: a 64-bit number for each text, from which its random numbers come.
    """
    floor = -float(len(lat.vocab.pieces))
    weight = lambda s: np.exp(alpha * np.maximum(s, floor))  # noqa: E731  scores under the ranks count as the last rank
    piece_w = weight(lat.piece_score)
    cps, starts, lens, owner = cut(texts, prefix, mark=True)
    example, which = distinct_tokens(cps, starts, lens)
    st, ln = starts[example], lens[example]
    base = np.cumsum(ln + 1) - (ln + 1)
    total = np.zeros(int((ln + 1).sum()))
    total[base] = 1.0
    first = np.zeros(len(total) + 1, np.int64)  # first edge of a node, in the order of steps
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_edges = 0
    reach = int(lat.piece_len.max(initial=1))
    for j, alive, letters, outputs in lat.steps(cps, st, ln):
        end = base[:alive] + j + 1
        found = list(outputs)
        many = np.ones(alive, np.int64)
        for at, _ in found:
            many[at] += 1
        offset = np.cumsum(many) - many
        cum = np.zeros(int(many.sum()))
        length = np.ones(len(cum), np.uint8)
        ident = np.empty(len(cum), np.int32)
        run = np.zeros(alive)
        for k, (at, out) in enumerate(found):
            run[at] += total[end[at] - lat.piece_len[out]] * piece_w[out]
            where = offset[at] + k
            cum[where], length[where], ident[where] = run[at], lat.piece_len[out], lat.piece_id[out]
        run += total[end - 1] * weight(lat.single_score[letters])
        last = offset + many - 1
        cum[last] = run
        ident[last] = np.where(lat.single_id[letters] >= 0, lat.single_id[letters], -1 - _actual(letters))
        total[end] = run
        first[end] = n_edges + offset
        edges.append((cum, length, ident))
        n_edges += len(cum)
        if j % 64 == 63:  # keep long tokens in range: scale the window that later steps read
            for w in np.flatnonzero(~((run > 1e-100) & (run < 1e100))):
                window = slice(int(end[w]) - min(reach, j + 1) + 1, int(end[w]) + 1)
                total[window] /= total[end[w]]
    cum = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0)
    length = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.uint8)
    ident = np.concatenate([e[2] for e in edges]) if edges else np.zeros(0, np.int32)
    # last edge of a node is its only edge of length 1 that ends the run: scanning stops there
    token_no = np.arange(len(starts)) - np.searchsorted(owner, owner, side="left")
    seeds = _mix(keys.astype(np.uint64)[owner] + _mix(token_no.astype(np.uint64) + _U(1)))
    token = np.arange(len(starts))
    node = base[which] + lens
    left = lens.copy()
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(token):
        u = (_mix(seeds[token] + _U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(11)).astype(np.float64) / float(1 << 53)
        edge = first[node].copy()
        target = u * _node_total(cum, length, edge)
        search = np.flatnonzero((cum[edge] <= target) & (length[edge] > 1))
        while len(search):
            edge[search] += 1
            search = search[(cum[edge[search]] <= target[search]) & (length[edge[search]] > 1)]
        taken.append((token, ident[edge]))
        node = node - length[edge]
        left = left - length[edge]
        go = left > 0
        token, node, left = token[go], node[go], left[go]
        step += 1
    n_steps = np.zeros(len(starts), np.int64)
    for t, _ in taken:
        n_steps[t] += 1
    place = np.cumsum(n_steps) - n_steps + n_steps
    flat = np.empty(int(n_steps.sum()), np.int64)
    for t, i in taken:  # steps go from the token's end to its start
        place[t] -= 1
        flat[place[t]] = i
    of_text = np.repeat(owner, n_steps)
    unknown = flat < 0
    width = np.where(unknown, lat.n_bytes[np.where(unknown, -1 - flat, 0)], 1)
    if unknown.any():
        ids = np.repeat(flat, width)
        at = np.cumsum(width) - width
        byte_ids = np.array(lat.vocab.byte_ids)
        spell = {int(c): byte_ids[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in np.unique(-1 - flat[unknown])}
        for c, b in spell.items():
            places = at[flat == -1 - c]
            for k, x in enumerate(b):
                ids[places + k] = x
    else:
        ids = flat
    return ids.astype(np.int32), np.bincount(of_text, weights=width, minlength=len(texts)).astype(np.int64)


def _node_total(cum: np.ndarray, length: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Running sum at the last edge (the only one of length 1) of each node."""
    last = edge.copy()
    more = np.flatnonzero(length[last] > 1)
    while len(more):
        last[more] += 1
        more = more[length[last[more]] > 1]
    return cum[last]


def decode(vocab: Vocabulary, ids) -> str:
    """The text of piece ids: pieces and bytes joined, U+2581 of pieces as a space."""
    return decoder(vocab)(ids)


def decoder(vocab: Vocabulary):
    table = {i: p.replace(chr(BAR), " ").encode() for p, _, i in vocab.pieces}
    table |= {i: bytes([b]) for b, i in enumerate(vocab.byte_ids)}
    return lambda ids: b"".join(map(table.__getitem__, ids)).decode("utf-8", "surrogatepass")


def _batches(parts: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of bounded size; null texts as empty ones."""
    keys: list = []
    texts: list[str] = []
    size = 0
    slices = (part.slice(a, ROWS_AT_ONCE) for part in parts for a in range(0, part.num_rows, ROWS_AT_ONCE))
    for part in slices:
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            text = text or ""
            if texts and size + len(text) > limit:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield keys, texts


def row_seeds(keys: list, seed: int) -> np.ndarray:
    """64 bits for each row key; any printable key will do."""
    raw = np.fromiter((zlib.crc32(repr(k).encode()) | zlib.adler32(repr(k).encode()) << 32 for k in keys), np.uint64, len(keys))
    return _mix(raw + _mix(np.full(len(keys), seed, np.uint64)))


def token_counts(docs: DataFrame, vocab: Vocabulary, prefix: bool = True) -> DataFrame:
    """doc_id, n_pieces of every document."""
    shared = _Shared(docs.sparkSession, vocab)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = shared.lattice()
        for keys, texts in _batches(parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(count_pieces(lat, texts, prefix))], ["doc_id", "n_pieces"]
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, n_pieces bigint")


def sampled_encoding(docs: DataFrame, vocab: Vocabulary, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """doc_id, pieces (sampled ids), n_pieces, text_crc32 (of the decoded text) of every document."""
    shared = _Shared(docs.sparkSession, vocab)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = shared.lattice()
        back = decoder(lat.vocab)
        for keys, texts in _batches(parts):
            ids, counts = sample_pieces(lat, texts, row_seeds(keys, seed), alpha)
            ends = np.concatenate([[0], np.cumsum(counts)])
            flat = ids.tolist()
            crcs = []
            for k, (text, a, b) in enumerate(zip(texts, ends[:-1], ends[1:])):
                if back(flat[a:b]) != text:
                    raise ValueError(f"row {keys[k]!r} does not decode to its text")
                crcs.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pieces, pa.array(counts), pa.array(crcs, pa.int64())],
                ["doc_id", "pieces", "n_pieces", "text_crc32"],
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(
        run, "doc_id bigint, pieces array<int>, n_pieces bigint, text_crc32 bigint"
    )


def decoded(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, pieces)."""
    shared = _Shared(encoded.sparkSession, vocab)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(shared())
        for part in parts:
            texts = [back(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "pieces").mapInArrow(run, "doc_id bigint, text string")
