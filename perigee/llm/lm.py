"""Operator 1, LM scoring: logistic mixing of hashed-context predictors, in bits per byte.

The text is a sequence of words (lower-cased A-Z) and one end.  Its probability is coded in two
levels, so that a word's bits are predicted once per distinct word and not once per occurrence:

* Spelling.  A word is the bits of its bytes and a terminator.  Six predictors look up the
  counts of zeros and ones after a hash of their context (the last 1 to 5 bytes, or all bytes of
  the word so far) and the bits of the byte so far.  Their stretched probabilities are added with weights
  picked by two gates (the highest context seen ``SEEN`` times; the bit's place in the byte), and the sum
  is refined by an adaptive probability map.  The counts come from all distinct training
  words; weights and map are learned online, each bit predicted without its own word's counts,
  over all distinct training words.
* Tokens.  From the corpus a token has P = (c - D(c) + (M + 1) * P_spelling) / (N + 1): its
  training count less a discount (by counts of counts, one for c = 1, 2 and more), and what the
  discounts free (M) spelled.  From the words before it, it has the shares c(pair) / c(word before) and c(triple) /
  c(pair before) of the whole training part, looked up by the hash of the context and the word; whether a token is coded
  by such a context is a hidden bit for each order, predicted along the text by adaptive rates of contexts that held,
  mixed with weights gated by the context's count.  A text's own pairs and triples are taken out of the counts before it is
  scored or learned from, so a training text is no likelier for being in the corpus once.  From its own text it has adaptive shares of "same as the last",
  "what followed the last token before" and the counts of the text so far.  Which of the two codes
  a token is a hidden bit, predicted online along the text by adaptive rates of repeats (all of
  the text so far, the last 16 tokens, after a repeat or not), mixed with weights gated by the
  position; the probability sums over the bit.  The weights are learned over all training texts,
  each without its own counts.

Every factor is a distribution, so ``score`` = log10 of the product is a proper log probability;
``bits_per_byte`` divides its bits by the bytes of the text.

Scale: the vocabulary is never broadcast nor collected.  Texts fall into blocks of about
``BLOCK_BYTES`` (their number grows with the input); a block yields its distinct words and its texts as numbers
of these, Spark sums the words to corpus counts, spells each distinct word, and joins the counts back to the blocks'
words; a block's texts and its own word list then meet in one task.  Pairs and triples go as 40-bit hashes, each of a block
once, sorted and cut by value into as many parts as there are blocks; a part adds them up and sends each block its own.  The spelling tables have a fixed size
(``SLOTS`` x 6) and are summed in two steps.  The spelling weights start alike in every group of ``LANE_WORDS`` words,
go over it in a fixed order and are averaged, each number by how often it was used there; the weights of the two codes
take one Newton step by the slopes of all training texts.  Exact sums make both the same under any partitioning.
Only training rows, crc32(doc_id as text) mod 10 <> 0, are counted or learned from.

A null doc_id is neither learned from nor held out; a null or empty text is one end token;
repeated rows are scored (and learned from) each; without training rows the counts are 0 and the
score is by spelling; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import copy
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import drop_written, text_or_empty, written, written_at
from perigee.session import shuffle_files_removed

BLOCK_BYTES = 6_000_000  # two workers with a block each, and its arrays, beside an executor's heap
SLOTS = 1 << 18
ORDERS = 6
LANE_WORDS = 50_000
AT_ONCE = 40_000  # tokens whose arrays stay in a core's cache
SPELLED_AT_ONCE = 1000
END = b"\n"
STOP = 0x20
SEEN = 300
CHUNK = 1 << 12
CONTEXT_ORDERS, KEY_BITS = (2, 3), 40  # words of a context and the token; bits of their hash
_U = np.uint64
GATES = 15


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower() and bytes.split() know A-Z and \\x20 \\x09-\\x0D only."""
    return (text or "").encode("utf-8", "replace").lower().split()


# ---------------------------------------------------------------- spelling


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with terminators, start of each word, and (ORDERS, bytes) context hashes."""
    flat = np.frombuffer(b"".join(w + b"\x20" for w in words), np.uint8)
    lens = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(lens) - lens
    place = np.arange(len(flat)) - np.repeat(starts, lens)
    hashes = np.empty((ORDERS, len(flat)), np.uint64)
    h = np.zeros(len(flat), np.uint64)
    for k in range(1, ORDERS):  # the last k bytes, 0 before the word
        before = np.zeros(len(flat), np.uint64)
        inside = place >= k
        before[inside] = flat[np.flatnonzero(inside) - k].astype(np.uint64) + _U(1)
        h = h * _U(257) + before
        hashes[k - 1] = _mix(h * _U(0x9E3779B97F4A7C15) + _U(k))
    # all bytes so far: differences of running sums of place-keyed byte hashes
    keyed = _mix((flat.astype(np.uint64) + _U(1)) * _U(0xA24BAED4963EE407) + place.astype(np.uint64) * _U(0x9FB21C651E98DF25))
    run = np.cumsum(keyed) - keyed
    hashes[ORDERS - 1] = _mix(run - np.repeat(run[starts], lens) + place.astype(np.uint64))
    return flat, starts, hashes


def bits_of(flat: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bit, (ORDERS, n) slots) for the eight bits of all bytes."""
    node = np.ones(len(flat), np.uint64)
    for b in range(8):
        bit = (flat >> (7 - b)) & 1
        slots = (_mix(hashes + node * _U(0xC2B2AE3D27D4EB4F)) & _U(SLOTS - 1)).view(np.int64)
        yield b, bit, slots
        node = node * _U(2) + bit.astype(np.uint64)


def _some(words: list[bytes], at_once: int = SPELLED_AT_ONCE) -> Iterator[list[bytes]]:
    """The words in their order, so many at a time that their arrays stay in a core's cache."""
    return (words[a : a + at_once] for a in range(0, len(words), at_once))


def count_bits(words: list[bytes], table: np.ndarray) -> None:
    """Add the bits of distinct words to ``table`` (ORDERS, 2, SLOTS)."""
    flat, _, hashes = contexts(words)
    at = np.empty((ORDERS, 8, len(flat)), np.int64)
    for b, bit, slots in bits_of(flat, hashes):
        at[:, b] = slots + bit * np.int64(SLOTS)
    for k in range(ORDERS):
        table[k] += np.bincount(at[k].ravel(), minlength=2 * SLOTS).reshape(2, SLOTS)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8).astype(np.float32)


class Speller:
    """Predictors' tables, gated weights and the adaptive probability map."""

    RATE, MAP_RATE, BATCH, BUCKETS = 0.002, 0.02, 4096, 33
    STEP = 256 / BATCH  # a batch moves the weights as 256 of its bits would

    def __init__(self, table: np.ndarray):
        self.stretch = stretched(table[:, 0], table[:, 1])
        self.seen = self.often(table.sum(1))
        self.by_order = np.full((ORDERS + 1, ORDERS), 0.15, np.float32)
        self.by_place = np.full((8, ORDERS), 0.15, np.float32)
        grid = np.linspace(-8, 8, self.BUCKETS)
        self.map = np.tile(1 / (1 + np.exp(-grid)), (ORDERS + 1, 1))
        self.used = [np.zeros(x.shape) for x in (self.by_order, self.by_place, self.map)]

    @staticmethod
    def often(n: np.ndarray) -> np.ndarray:
        """(ORDERS, ...) counts: number of the context where seen often, else 0."""
        return (n >= SEEN) * np.arange(1, ORDERS + 1, dtype=np.uint8).reshape(-1, *[1] * (n.ndim - 1))

    @classmethod
    def without_itself(cls, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and contexts seen often of a bit whose own word is taken out of the counts:
        (ORDERS, 2 * SLOTS), by bit and slot."""
        n0, n1 = table[:, 0], table[:, 1]
        less0, less1 = np.maximum(n0 - 1, 0), np.maximum(n1 - 1, 0)
        stretch = np.concatenate([stretched(less0, n1), stretched(n0, less1)], axis=1)
        return stretch, cls.often(np.concatenate([less0 + n1, n0 + less1], axis=1))

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights and map values in one row, and how often each was used."""
        return np.concatenate([x.ravel() for x in (self.by_order, self.by_place, self.map)]), np.concatenate([x.ravel() for x in self.used])

    def set_learned(self, row: np.ndarray) -> None:
        a, b = self.by_order.size, self.by_order.size + self.by_place.size
        self.by_order = row[:a].reshape(self.by_order.shape).astype(np.float32)
        self.by_place = row[a:b].reshape(self.by_place.shape).astype(np.float32)
        self.map = row[b:].reshape(self.map.shape)

    @staticmethod
    def looked_up(slots: np.ndarray, stretch: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions (ORDERS, n) at the slots, and the gate: the number of the highest context seen often, or 0."""
        st = np.stack([stretch[k].take(slots[k]) for k in range(ORDERS)])
        gate = seen[0].take(slots[0])
        for k in range(1, ORDERS):
            np.maximum(gate, seen[k].take(slots[k]), out=gate)
        return st, gate

    def mixed(self, st: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Sum of the predictions by the weights of their ``cell``: gate * 8 + place."""
        w = (self.by_order[:, None] + self.by_place).reshape(-1, ORDERS).T
        return np.clip((w.take(cell, axis=1) * st).sum(0), -8, 8)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The map's probability, the lower of the two buckets it lies between (in the flat map) and the part of the upper."""
        x = (z + 8) * ((self.BUCKETS - 1) / 16)
        low = np.minimum(x.astype(np.int64), self.BUCKETS - 2)
        part = x - low
        low += gate * np.int64(self.BUCKETS)
        flat = self.map.ravel()
        return flat.take(low) * (1 - part) + flat.take(low + 1) * part, low, part

    def learn(self, words: list[bytes], table: np.ndarray) -> None:
        """One online pass over the bits of distinct training words, in their order."""
        self.learn_apart(words, *self.without_itself(table))

    def learn_apart(self, words: list[bytes], stretch: np.ndarray, seen: np.ndarray) -> None:
        """As ``learn``, from ``without_itself`` of the counts."""
        for some in _some(words):
            self._learn(some, stretch, seen)

    def _learn(self, words: list[bytes], stretch: np.ndarray, seen: np.ndarray) -> None:
        flat, _, hashes = contexts(words)
        st, gate, bit = np.empty((ORDERS, len(flat), 8), np.float32), np.empty((len(flat), 8), np.int64), np.empty((len(flat), 8), np.uint8)
        for b, y, slots in bits_of(flat, hashes):
            st[:, :, b], gate[:, b] = self.looked_up(slots + y * np.int64(SLOTS), stretch, seen)
            bit[:, b] = y
        cell = (gate * 8 + np.arange(8)).ravel()  # byte by byte
        st, gate, bit = st.reshape(ORDERS, -1), gate.ravel(), bit.ravel()
        cells, n = (ORDERS + 1) * 8, self.map.size
        lows, parts = np.empty(len(bit), np.int64), np.empty(len(bit))
        for a in range(0, len(bit), self.BATCH):
            here = slice(a, a + self.BATCH)
            s, c, y = st[:, here], cell[here], bit[here]
            z = self.mixed(s, c)
            p, low, part = self.refined(z, gate[here])
            step = self.STEP * self.RATE * (y - 1 / (1 + np.exp(-z))) * s  # (ORDERS, n)
            moved = np.stack([np.bincount(c, x, cells) for x in step], 1).reshape(ORDERS + 1, 8, ORDERS)
            self.by_order += moved.sum(1).astype(np.float32)
            self.by_place += moved.sum(0).astype(np.float32)
            err = self.STEP * self.MAP_RATE * (y - p)
            up = err * part
            moved = np.bincount(low, err - up, n) + np.bincount(low + 1, up, n)
            self.map = np.clip(self.map + moved.reshape(self.map.shape), 1e-4, 1 - 1e-4)
            lows[here], parts[here] = low, part
        used = np.bincount(cell, minlength=cells).reshape(ORDERS + 1, 8)
        self.used[0] += used.sum(1)[:, None]
        self.used[1] += used.sum(0)[:, None]
        self.used[2] += (np.bincount(lows, 1 - parts, n) + np.bincount(lows + 1, parts, n)).reshape(self.map.shape)

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word's spelling."""
        return np.concatenate([np.zeros(0), *map(self._log_probs, _some(words))])

    def _log_probs(self, words: list[bytes]) -> np.ndarray:
        flat, starts, hashes = contexts(words)
        total = np.zeros(len(flat))
        for b, bit, slots in bits_of(flat, hashes):
            st, gate = self.looked_up(slots, self.stretch, self.seen)
            z = self.mixed(st, gate * np.int64(8) + b)
            p = (1 / (1 + np.exp(-z)) + self.refined(z, gate)[0]) / 2
            total += np.log(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(total, starts)


# ---------------------------------------------------------------- tokens of texts


def repeats(ids: np.ndarray, first: np.ndarray, lens: np.ndarray) -> dict[str, np.ndarray]:
    """What each token repeats: arrays over all tokens of texts (ids; first token and length of each)."""
    n = len(ids)
    doc = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(n) - first[doc]
    order = np.sort(ids * n + np.arange(n)) % n  # by word, then as they stand: those of one text lie together
    word, text = ids[order], doc[order]
    same = np.zeros(n, bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    run = np.arange(n)
    starts = np.flatnonzero(~same)
    many = np.diff(starts, append=n)
    earlier = np.empty(n, np.int64)
    earlier[order] = run - np.repeat(starts, many)
    in_text = np.empty(n, np.int64)
    in_text[order] = np.repeat(many, many)
    last = np.full(n, -1)
    last[order[1:]] = np.where(same[1:], order[:-1], -1)
    like_last = np.zeros(n, bool)
    like_last[1:] = (ids[1:] == ids[:-1]) & (at[1:] > 0)
    follow = np.zeros(n, bool)
    before = np.flatnonzero(at > 0)
    seen = before[last[before - 1] >= 0]
    follow[seen] = ids[last[seen - 1] + 1] == ids[seen]
    return {"doc": doc, "at": at, "earlier": earlier, "in_text": in_text, "repeat": earlier > 0, "like_last": like_last, "follow": follow}


def _before(x: np.ndarray, first_of: np.ndarray) -> np.ndarray:
    """Sum of x over the earlier tokens of the same text."""
    run = np.cumsum(x) - x
    return run - run[first_of]


def rates(r: dict[str, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5, n) stretched predictions that a token is a repeat, and its gate."""
    first_of = first[r["doc"]]
    at = r["at"].astype(np.float64)
    y = r["repeat"].astype(np.float64)
    so_far = _before(y, first_of)
    run = np.cumsum(y) - y
    back = np.maximum(np.arange(len(y)) - 16, first_of)
    recent = run - run[back]
    prev = np.zeros(len(y))
    prev[1:] = np.where(r["at"][1:] > 0, y[:-1], 0)
    both, before = _before(y * prev, first_of), _before(prev, first_of)
    after = np.where(prev > 0, both, so_far - both)
    chances = np.where(prev > 0, before, at - before)
    ps = [
        (so_far + 0.4) / (at + 0.8),
        (recent + 0.4) / (np.minimum(at, 16) + 0.8),
        (after + 0.4) / (chances + 0.8),
    ]
    cols = [np.log(p / (1 - p)) for p in ps] + [np.ones(len(y)), prev]
    return np.clip(np.stack(cols), -8, 8), np.minimum(np.log2(at + 1).astype(np.int64), GATES - 1)


def own_text(r: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    """Probability of each token from its own text so far (0 for the first)."""
    first_of = first[r["doc"]]
    many = _before(r["repeat"].astype(float), first_of)
    a = (_before(r["like_last"].astype(float), first_of) + 0.1) / (many + 0.4)
    f = (_before((r["follow"] & ~r["like_last"]).astype(float), first_of) + 0.1) / (many + 0.4)
    a, f = np.minimum(a, 0.94), np.minimum(f, 0.94)
    over = np.maximum(a + f, 0.95) / 0.95  # a share of 0.05 stays for the counts of the text
    a, f = a / over, f / over
    return a * r["like_last"] + f * r["follow"] + (1 - a - f) * r["earlier"] / np.maximum(r["at"], 1)


class Corpus:
    """Token probabilities from corpus counts and spelling. many: words that occur 1, 2, 3, 4 times."""

    def __init__(self, n: int, v: int, many: tuple[int, int, int, int]):
        self.n, self.v = n, v
        n1, n2, n3, n4 = (max(x, 1) for x in many)
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        self.discount = np.array([0.0, *(min(max(x, 0.1), 0.9 * (k + 1)) for k, x in enumerate(d))])
        self.free = float(self.discount[1] * many[0] + self.discount[2] * many[1] + self.discount[3] * (v - many[0] - many[1]))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def prob(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """From counts and the probability of the spelling."""
        d = self.discount[np.clip(c, 0, 3).astype(np.int64)]
        return (c - d + (self.free + 1) * spelled) / (self.n + 1)


class Mixer:
    """Chance of a hidden bit, from stretched predictions weighted by gate."""

    def __init__(self, start: list[float]):
        self.w = np.tile(np.array(start), (GATES, 1))

    def predict(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.clip((self.w.T.take(gate, axis=1) * x).sum(0), -12, 12)
        return 1 / (1 + np.exp(-z))

    def slopes(self, x: np.ndarray, gate: np.ndarray, old: np.ndarray, new: np.ndarray, share: np.ndarray | float = 1.0) -> np.ndarray:
        """(GATES, k, k + 1): per gate, curvature and slope of the tokens' log probability in the k weights; old, new: their
        probability by the code of the bit and by what is left; share: how likely the bit was asked at all.  Slopes of all
        texts add up, in any order."""
        p = self.predict(x, gate)
        own = p * old
        err = share * (own / (own + (1 - p) * new) - p)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x, curve, err = x[:, order], (share * p * (1 - p))[order], err[order]
        ends = np.cumsum(np.bincount(gate, minlength=GATES))
        out = np.zeros((GATES, len(x), len(x) + 1))
        for g, (a, b) in enumerate(zip([0, *ends], ends)):
            part = x[:, a:b]
            out[g, :, :-1] = (part * curve[a:b]) @ part.T
            out[g, :, -1] = part @ err[a:b]
        return out

    def step(self, slopes: np.ndarray) -> None:
        """A Newton step to the weights under which the tokens are likelier, the hidden bit as it looks now."""
        for g, part in enumerate(slopes):
            self.w[g] += np.linalg.solve(part[:, :-1] + np.eye(len(part)), part[:, -1])


class SourceMixer(Mixer):
    """Chance that a token is coded by its own text, from the rates of repeats so far; ``contexts``: that what is left is
    coded by the word before, and by the two words before, from the rates of such contexts that held so far."""

    def __init__(self):
        super().__init__([0.4, 0.3, 0.3, -2.0, 0.0])
        self.contexts = [Mixer([0.5, 0.5, -1.0, 0.5]) for _ in CONTEXT_ORDERS]

    def all(self) -> list[Mixer]:
        return [self, *self.contexts]


def held_rates(c: np.ndarray, total: np.ndarray, r: dict[str, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose context is known (total > 0), (4, n) stretched predictions that it holds, and its gate; c: how often the
    token followed it."""
    first_of = first[r["doc"]]
    known, held = (total > 0).astype(np.float64), (c > 0).astype(np.float64)
    chances, hits = np.cumsum(known) - known, np.cumsum(held) - held
    at = np.flatnonzero(total > 0)
    start, back = first_of[at], np.maximum(at - 16, first_of[at])
    ps = [(hits[at] - hits[z] + 0.4) / (chances[at] - chances[z] + 0.8) for z in (start, back)]
    before = np.where(at > start, held[np.maximum(at - 1, 0)], 0.0)
    x = np.stack([*(np.log(p / (1 - p)) for p in ps), np.ones(len(at)), before])
    return at, np.clip(x, -8, 8), np.minimum(np.log2(total[at]).astype(np.int64), GATES - 1)


def by_contexts(
    new: np.ndarray, before: np.ndarray, grams: list[np.ndarray], r: dict[str, np.ndarray], first: np.ndarray, mixer: SourceMixer
) -> tuple[np.ndarray, list[tuple]]:
    """Probability of each token by the corpus and the words before it, and what each order did: its tokens, predictions,
    gate, share of the context, probability below and chance of its bit.  new: by the corpus alone; before: counts of single
    words; grams: those of pairs and triples that end at the token."""
    steps = []
    for order, c, bit in zip(CONTEXT_ORDERS, grams, mixer.contexts):
        total = np.zeros(len(new))
        total[1:] = before[:-1]
        total[r["at"] < order - 1] = 0
        at, x, gate = held_rates(c, total, r, first)
        share, q = np.minimum(c[at] / total[at], 1), bit.predict(x, gate)
        steps.append((at, x, gate, share, new[at], q))
        new = new.copy()
        new[at] = q * share + (1 - q) * new[at]
        before = c
    return new, steps


def text_slopes(
    ids: np.ndarray, first: np.ndarray, lens: np.ndarray, grams: list[np.ndarray], learn: np.ndarray, count: np.ndarray,
    spelled: np.ndarray, corpus: Corpus, mixer: SourceMixer,
) -> np.ndarray:
    """``Mixer.slopes`` of all bits in training texts, each without its own counts; count, spelled by word index."""
    r = repeats(ids, first, lens)
    single = np.maximum(count[ids] - r["in_text"], 0)
    new, steps = by_contexts(corpus.prob(single, spelled[ids]), single, grams, r, first, mixer)
    x, gate = rates(r, first)
    own, later = own_text(r, first), r["at"] > 0  # the first token is never its text's
    sums = [mixer.slopes(x[:, later], gate[later], own[later], new[later])]
    p = np.where(later, mixer.predict(x, gate), 0.0)
    asked = (1 - p) * new / (p * own + (1 - p) * new)  # how likely the token is not its text's
    found = []
    for (at, x, gate, share, below, q), bit in zip(reversed(steps), reversed(mixer.contexts)):
        found.append(bit.slopes(x, gate, share, below, asked[at]))
        asked = asked.copy()
        asked[at] *= (1 - q) * below / (q * share + (1 - q) * below)
    return np.concatenate([x.ravel() for x in (*sums, *reversed(found))])


def block_scores(
    ids: np.ndarray, first: np.ndarray, lens: np.ndarray, grams: list[np.ndarray], learn: np.ndarray, count: np.ndarray,
    known: np.ndarray, base: np.ndarray, new: np.ndarray, mixer: SourceMixer,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, score) of each text; count, known, base, probability by the corpus by word index;
    learn: texts whose words are counted."""
    r = repeats(ids, first, lens)
    single = np.maximum(count[ids] - r["in_text"] * learn[r["doc"]], 0)
    by_corpus = by_contexts(new[ids], single, grams, r, first, mixer)[0]
    p = np.where(r["at"] == 0, 0.0, mixer.predict(*rates(r, first)))
    score = np.log10(p * own_text(r, first) + (1 - p) * by_corpus)
    per_text = lambda x: np.add.reduceat(x, first)
    return lens, per_text(known[ids]), per_text(base[ids]), per_text(score)


# ---------------------------------------------------------------- pairs and triples of words


def gram_keys(ids: np.ndarray, lens: np.ndarray, hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens with ``order - 1`` words before them in their text, and the hash of these words and the token;
    ids of all texts one after another, hashes by word number."""
    h = _mix(hashes.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(order))[ids]
    key = h
    for _ in range(order - 1):
        key = _mix(key[:-1] * _U(0xA24BAED4963EE407) + h[len(h) - len(key) + 1 :])
    ends = np.cumsum(lens)
    whole = np.ones(len(ids), bool)  # not so the first tokens of a text
    for back in range(order - 1):
        begins = ends - lens + back
        whole[begins[begins < ends]] = False
    at = np.flatnonzero(whole)
    key = key[at - (order - 1)]
    key >>= _U(64 - KEY_BITS)
    return at, key


def distinct_grams(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and how often it is learned from."""
    both = np.sort(keys << _U(1) | learned.astype(np.uint64))
    starts = np.flatnonzero(np.diff(both >> _U(1), prepend=_U(2**63)))
    return (both >> _U(1))[starts], np.add.reduceat((both & _U(1)).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def others_counts(at: np.ndarray, keys: np.ndarray, counts: np.ndarray, doc: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """For each token its key's count without those of its own text; counts by ``distinct_grams``; doc: text of each token."""
    out = np.zeros(len(doc), np.uint32)
    if not len(at):
        return out
    if len(at) < 1 << (64 - KEY_BITS):  # by key, then as they stand
        both = np.sort(keys << _U(64 - KEY_BITS) | np.arange(len(at), dtype=np.uint64))
        order, key = (both & _U((1 << (64 - KEY_BITS)) - 1)).astype(np.int64), both >> _U(64 - KEY_BITS)
    else:
        order = np.argsort(keys, kind="stable")
        key = keys[order]
    place = at[order]
    text = doc[place]
    other = np.ones(len(key), bool)
    other[1:] = key[1:] != key[:-1]
    runs = other.copy()
    runs[1:] |= text[1:] != text[:-1]
    starts = np.flatnonzero(runs)
    many = np.diff(starts, append=len(key))
    out[place] = counts[np.cumsum(other) - 1] - np.repeat(many * learn[text[starts]], many)
    return out


# ---------------------------------------------------------------- Spark


BLOCK = (
    "block bigint, doc_id bigint, held_out boolean, learn boolean, bytes bigint, ids binary, "  # of a text
    "hashes binary, "  # of the block's words, in its first text
    "i bigint, word binary, n bigint"  # of a word
)


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``tokens`` of all texts and their ends as numbers of the distinct words, in the order in which they come; the length of
    each text; the words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    is_word = pc.greater(pc.binary_length(split.values), 0)  # white space at an end leaves an empty string
    words = split.values.filter(is_word).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(is_word.to_numpy(zero_copy_only=False))])
    lens = np.diff(before[split.offsets.to_numpy()]) + 1
    ids = np.zeros(int(lens.sum()), np.int32)  # 0: the end
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(lens) - 1] = False
    ids[inside] = words.indices.to_numpy() + 1
    return ids, lens, pa.concat_arrays([pa.array([END], pa.binary()), words.dictionary.cast(pa.binary())])


def _of_texts(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """4-byte values of all tokens as one binary for each text."""
    offsets = np.concatenate([[0], 4 * np.cumsum(lens)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _block_words(block: pa.Table) -> pa.Table:
    """``BLOCK`` rows: the texts as numbers of the block's words, and these words; n counts training texts only."""
    text = block["text"].combine_chunks()
    ids, lens, index = _numbered(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
    learned = ids[np.repeat(block["learn"].to_numpy(), lens)]
    n = np.bincount(learned, minlength=len(index))
    number = block["block"][0].as_py()
    hashes = np.fromiter(map(zlib.crc32, index.to_pylist()), np.uint32, len(index)).tobytes()
    texts = {
        "block": pa.array(np.full(len(lens), number), pa.int64()),
        **{c: block[c] for c in ("doc_id", "held_out", "learn")},
        "bytes": pc.fill_null(pc.binary_length(block["text"]), 0).cast(pa.int64()),
        "ids": _of_texts(ids, lens),
        "hashes": pa.array([hashes, *[None] * (len(lens) - 1)], pa.binary()),
        **{c: pa.nulls(len(lens), t) for c, t in (("i", pa.int64()), ("word", pa.binary()), ("n", pa.int64()))},
    }
    words = {
        "block": pa.array(np.full(len(index), number), pa.int64()),
        **{c: pa.nulls(len(index), pa.table(texts)[c].type) for c in ("doc_id", "held_out", "learn", "bytes", "ids", "hashes")},
        "i": pa.array(np.arange(len(index)), pa.int64()),
        "word": index,
        "n": pa.array(n, pa.int64()),
    }
    return pa.concat_tables([pa.table(texts), pa.table(words)])


def _block_grams(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a block's texts, the length of each, whether it is learned from, and the hashes of its words."""
    lens = pc.binary_length(block["ids"]).to_numpy().astype(np.int64) // 4
    ids = np.frombuffer(b"".join(block["ids"].to_pylist()), np.int32)
    hashes = np.frombuffer(next(x for x in block["hashes"].to_pylist() if x is not None), np.uint32)
    return ids, lens, block["learn"].to_numpy(), hashes


def _gram_counts(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, part, gram, counts): how often each of the block's distinct pairs or triples is in the training texts, in the
    order of their hashes within a part."""

    def send(block: pa.Table) -> pa.Table:
        ids, lens, learn, hashes = _block_grams(block)
        at, keys = gram_keys(ids, lens, hashes, order)
        keys, n = distinct_grams(keys, np.repeat(learn, lens)[at])
        bounds = np.array([-(-(p << KEY_BITS) // parts) for p in range(parts + 1)], np.uint64)
        cuts = np.searchsorted(keys, bounds)
        some = np.flatnonzero(np.diff(cuts))
        short = keys.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        return pa.table(
            {
                "block": pa.array(np.full(len(some), block["block"][0].as_py()), pa.int64()),
                "part": pa.array(some, pa.int64()),
                "keys": pa.array([short[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()),
                "n": pa.array([n[cuts[p] : cuts[p + 1]].astype(np.uint32).tobytes() for p in some], pa.binary()),
            }
        )

    def add(part: pa.Table) -> pa.Table:
        n = np.frombuffer(b"".join(part["n"].to_pylist()), np.uint32)
        keys = np.zeros((len(n), 8), np.uint8)
        keys[:, : KEY_BITS // 8] = np.frombuffer(b"".join(part["keys"].to_pylist()), np.uint8).reshape(len(n), -1)
        _, of = np.unique(keys.view(np.uint64).ravel(), return_inverse=True)
        counts = np.bincount(of, n)[of].astype(np.uint32)
        lens = pc.binary_length(part["n"]).to_numpy().astype(np.int64) // 4
        return pa.table(
            {"block": part["block"], "part": part["part"], "gram": pa.array(np.full(len(lens), order), pa.int64()), "counts": _of_texts(counts, lens)}
        )

    sent = texts.select("block", "learn", "ids", "hashes").groupBy("block").applyInArrow(send, "block bigint, part bigint, keys binary, n binary")
    return sent.groupBy("part").applyInArrow(add, "block bigint, part bigint, gram bigint, counts binary")


TEXT = "block bigint, doc_id bigint, held_out boolean, learn boolean, bytes bigint, ids binary"
GRAMS = [f"gram{k}" for k in CONTEXT_ORDERS]


def _with_grams(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``TEXT`` rows with the counts of each token's pair and triple in the other training texts."""

    def look_up(block: pa.Table, found: pa.Table) -> pa.Table:
        ids, lens, learn, hashes = _block_grams(block)
        doc = np.repeat(np.arange(len(lens)), lens)
        out = {c: block[c] for c in ("block", "doc_id", "held_out", "learn", "bytes", "ids")}
        found = found.sort_by("part")
        for order, name in zip(CONTEXT_ORDERS, GRAMS):
            mine = found.filter(pc.equal(found["gram"], order))
            n = np.frombuffer(b"".join(mine["counts"].to_pylist()), np.uint32).astype(np.int64)
            out[name] = _of_texts(others_counts(*gram_keys(ids, lens, hashes, order), n, doc, learn), lens)
        return pa.table(out)

    schema = ", ".join([TEXT, *[f"{g} binary" for g in GRAMS]])
    return texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(look_up, schema)


def _count_chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's bit counts, cut into chunks of equal size."""
    table = np.zeros((ORDERS, 2, SLOTS), np.int64)
    any_rows = 0
    for part in parts:
        words = part.column(0).to_pylist()
        any_rows += len(words)
        if words:
            count_bits(words, table)
    if not any_rows:
        return
    chunks = table.reshape(-1, CHUNK)
    lane = int(table[0, 1].sum()) % 64
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(chunks)), pa.int64()), pa.array(np.full(len(chunks), lane), pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())],
        ["chunk", "lane", "counts"],
    )


def _add_chunks(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in group["counts"].to_pylist())
    return pa.table({"chunk": group["chunk"][:1], "lane": group["lane"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def spelling_table(words: DataFrame) -> np.ndarray:
    """Bit counts of all distinct words (column word): a table of fixed size."""
    schema = "chunk bigint, lane bigint, counts binary"
    chunks = words.select("word").mapInArrow(_count_chunks, schema)
    lanes = chunks.groupBy("chunk", "lane").applyInArrow(_add_chunks, schema)
    rows = lanes.groupBy("chunk").applyInArrow(_add_chunks, schema).collect()  # ORDERS * 2 * SLOTS numbers
    table = np.zeros((ORDERS * 2 * SLOTS // CHUNK, CHUNK), np.int64)
    for r in rows:
        table[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return table.reshape(ORDERS, 2, SLOTS)


SUMS = "sums array<double>"


def _sums_row(sums: np.ndarray) -> pa.Table:
    return pa.table({"sums": pa.array([sums.ravel()], pa.list_(pa.float64()))})


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The ``SUMS`` rows added up by place, exactly, so in any order."""
    each = rows.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,12)")).alias("x"))
    out = np.zeros(size)
    for r in each.collect():  # size rows
        out[r["at"]] = float(r["x"])
    return out


def _learned_speller(known: DataFrame, n_words: int, table: np.ndarray) -> Speller:
    """Weights and map learned over all distinct training words (column word)."""
    start = Speller(table)
    shared = known.sparkSession.sparkContext.broadcast((start, *Speller.without_itself(table)))  # fixed size

    def learn(lane: pa.Table) -> pa.Table:
        start, *apart = shared.value
        speller = copy.deepcopy(start)
        # an order that has nothing to do with the alphabet
        speller.learn_apart(sorted(lane["word"].to_pylist(), key=lambda w: (zlib.crc32(w), w)), *apart)
        learned, used = speller.learned()
        return _sums_row(np.concatenate([learned * used, used]))

    lanes = max(1, math.ceil(n_words / LANE_WORDS))
    rows = known.select(F.pmod(F.xxhash64("word"), F.lit(lanes)).alias("lane"), "word").groupBy("lane").applyInArrow(learn, SUMS)
    before = start.learned()[0]
    learned, used = np.split(_summed(rows, 2 * len(before)), 2)
    start.set_learned(np.where(used > 0, learned / np.maximum(used, 1e-9), before))
    return start


def _texts_at_once(block: pa.Table) -> Iterator[tuple]:
    """Word numbers of some texts at a time, first token and length of each, counts of the tokens' pairs and triples, texts that
    are learned from: the arrays are many times the text."""
    lens = pc.binary_length(block["ids"]).to_numpy().astype(np.int64) // 4
    ends, learn = np.cumsum(lens), block["learn"].to_numpy()
    a = 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - lens[a] + AT_ONCE, side="right")))
        ids = np.frombuffer(b"".join(block["ids"][a:b].to_pylist()), np.int32).astype(np.int64)
        grams = [np.frombuffer(b"".join(block[g][a:b].to_pylist()), np.uint32).astype(np.float64) for g in GRAMS]
        yield ids, ends[a:b] - lens[a:b] - (ends[a] - lens[a]), lens[a:b], grams, learn[a:b]
        a = b


def _lexicon_of(vocabulary: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and probabilities of the spelling, by the block's word numbers."""
    at = np.argsort(vocabulary["i"].to_numpy())  # each number once
    return vocabulary["c"].to_numpy()[at].astype(np.float64), np.exp(vocabulary["spell"].to_numpy()[at])


def _learned_mixer(texts: DataFrame, listed: DataFrame, model: Corpus) -> SourceMixer:
    """Weights of all bits learned over all training texts, without each text's own counts."""
    shapes = [(*m.w.shape, m.w.shape[1] + 1) for m in SourceMixer().all()]
    sizes = [math.prod(x) for x in shapes]

    def learn(block: pa.Table, vocabulary: pa.Table) -> pa.Table:
        mixer = SourceMixer()
        sums = np.zeros(sum(sizes))
        if block.num_rows:
            lexicon = _lexicon_of(vocabulary)
            for texts in _texts_at_once(block):
                sums += text_slopes(*texts, *lexicon, model, mixer)
        return _sums_row(sums)

    learned = texts.where("learn").select("block", "ids", "learn", *GRAMS)
    rows = learned.groupBy("block").cogroup(listed.groupBy("block")).applyInArrow(learn, SUMS)
    mixer = SourceMixer()
    for bit, shape, sums in zip(mixer.all(), shapes, np.split(_summed(rows, sum(sizes)), np.cumsum(sizes)[:-1])):
        bit.step(sums.reshape(shape))
    return mixer


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(rest == 0, F.lit(False)).alias("held_out"),
        F.coalesce(rest != 0, F.lit(False)).alias("learn"),
    )
    size = rows.agg(F.sum(F.octet_length(text_or_empty(F.col("text"))).cast("bigint") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    with shuffle_files_removed(spark):
        numbered, numbered_path = written_at(blocked.groupBy("block").applyInArrow(_block_words, BLOCK), "lm-blocks", "zstd")
        words, texts = numbered.where("word IS NOT NULL"), numbered.where("word IS NULL")
        counts = [written_at(_gram_counts(texts, k, blocks), "lm-grams", "zstd") for k in CONTEXT_ORDERS]
        texts, _ = written_at(_with_grams(texts, functools.reduce(DataFrame.unionByName, [df for df, _ in counts])), "lm-texts", "zstd")
        drop_written(spark, *[path for _, path in counts])
        corpus, corpus_path = written_at(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-corpus")
        totals = corpus.agg(
            F.sum("c").alias("n"),
            F.count_if(F.col("c") > 0).alias("v"),
            *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)],
        ).first()
        model = Corpus(totals["n"] or 0, totals["v"] or 0, tuple(totals[f"n{k}"] for k in range(1, 5)))

        known = corpus.where("c > 0").select("word")
        speller = _learned_speller(known, model.v, spelling_table(known))
        spells = spark.sparkContext.broadcast(speller)  # fixed size

        def spelled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            speller = spells.value
            for part in parts:
                lp = speller.log_probs(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lp)], ["word", "c", "spell"])

        lexicon, lexicon_path = written_at(corpus.mapInArrow(spelled, "word binary, c bigint, spell double"), "lm-lexicon")
        drop_written(spark, corpus_path)
        # joined once, read by the learning and by the scoring
        listed = written(words.select("block", "i", "word").join(lexicon, "word").select("block", "i", "c", "spell"), "lm-listed")
        drop_written(spark, lexicon_path, numbered_path)
        mixer = _learned_mixer(texts, listed, model)
    shared = spark.sparkContext.broadcast((mixer, model))  # fixed size

    def scored(block: pa.Table, vocabulary: pa.Table) -> pa.Table:
        mixer, model = shared.value
        count, spelled = _lexicon_of(vocabulary)
        lexicon = count, (count > 0).astype(np.int64), model.base(count), model.prob(count, spelled)
        size = np.maximum(1, block["bytes"].to_numpy())
        parts = [block_scores(*texts, *lexicon, mixer) for texts in _texts_at_once(block)]
        lens, hits, base, score = (np.concatenate(x) for x in zip(*parts))
        return pa.table(
            {
                "doc_id": block["doc_id"],
                "held_out": block["held_out"],
                "n_tokens": pa.array(lens, pa.int64()),
                "n_known": pa.array(hits, pa.int64()),
                "train_tokens": pa.array(np.full(len(lens), model.n), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(-score * math.log2(10) / size, pa.float64()),
            }
        )

    return (
        texts.select("block", "doc_id", "held_out", "learn", "bytes", "ids", *GRAMS)
        .groupBy("block")
        .cogroup(listed.groupBy("block"))
        .applyInArrow(
            scored,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double, bits_per_byte double",
        )
    )
