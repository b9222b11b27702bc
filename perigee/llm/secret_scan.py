"""Operator 12, secret scan: fixed patterns, and strings that a primed compressor finds new.

Base spans are the patterns of ``ASSIGN``, ``ACCESS`` and ``HEX`` over the whole text.  The method adds
strings in which a letter and a digit meet and that stand within ``REACH`` code points after a word such
as ``secret``, ``auth`` or ``key``, by novelty: the bytes that the candidate adds to the zstandard frame
of its surroundings, with a dictionary of the corpus' identifiers as the compressor's history.  A
name, a path or a copy of something near by costs a few bytes for a reference; a random string costs
nearly a byte a letter.  Candidates of at least ``NOVEL`` bytes a letter are reported as kind ``novel``.

The dictionary holds the identifiers (letters and underscores only, so that no key with digits gets
into it) that occur most often in the whole corpus, counted by Spark, the most frequent last (a zstandard
history reaches its end most cheaply); its size is the parameter ``DICTIONARY_BYTES``, which also bounds
what the driver receives.

Offsets are code points, ends exclusive.  Null and empty texts have no spans; the doc_id is only handed
through, so null and repeated ones are fine; repeated rows get equal spans; an empty table gives an empty
result.  ``scan_secrets`` keeps all columns and adds one array; a column of that name is replaced.  Arrow
batches are bounded in bytes by Spark; a text is decoded only if a byte search finds a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns with the length each must have, in the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = (
    "secret", "token", "passw", "passphrase", "pwd", "credential", "auth", "bearer", "private",
    "apikey", "api_key", "access", "key", "signature", "session",
)
REACH = 96  # code points after a sensitive word in which a candidate may begin
MIN_NOVEL = 12  # letters of a candidate
AROUND = 512  # code points of surroundings on each side
NOVEL = 0.68  # marginal bytes a letter; random base64 beside more of its kind takes 0.7 to 0.77
DICTIONARY_BYTES = 32_768
MIN_IDENTIFIER, MAX_IDENTIFIER = 4, 64
LEVEL = 19

SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# the longest runs are those of the base patterns; shorter ones would be dropped anyway
_access = re.compile(rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}")
_hex = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
_sensitive = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
_candidate = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_NOVEL},}}")
_mixed = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_SENSITIVE_BYTES = [w.encode() for w in SENSITIVE]
_HEX_MASK = bytes(ord("x") if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The corpus' most frequent identifiers, ties by spelling, the most frequent last; at most ``size`` bytes."""
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z_]{{{MIN_IDENTIFIER},}}"), F.lit(0)))
    counts = docs.select(found.alias("name")).where(F.length("name") <= MAX_IDENTIFIER).groupBy("name").count()
    # a name takes at least MIN_IDENTIFIER + 1 bytes, so no more rows can be needed
    most = counts.orderBy(F.desc("count"), "name").limit(size // (MIN_IDENTIFIER + 1)).collect()
    names, room = [], size
    for row in most:
        room -= len(row["name"]) + 1
        if room < 0:
            break
        names.append(row["name"])
    return "\n".join(reversed(names)).encode()


class Novelty:
    """Marginal compressed bytes of a string beside its surroundings."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        primed = None
        if dictionary:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=level)
        self._zstd = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def added(self, surroundings: str, candidate: str) -> int:
        frame = surroundings.encode("utf-8", "surrogatepass")
        return len(self._zstd.compress(frame + candidate.encode())) - len(self._zstd.compress(frame))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in _hex.finditer(text)]


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates after a sensitive word that no base span meets and that compress badly; lines that go on
    after a reported one count as after the same word."""
    near = [(m.end(), m.end() + REACH) for m in _sensitive.finditer(text)]
    taken = sorted((s, e) for s, _, e in base)
    out: list[tuple[int, int, int]] = []
    i, j, last, until = 0, 0, -9, -1
    for m in _candidate.finditer(text):
        start, end = m.span()
        while i < len(near) and near[i][0] <= start:
            until = near[i][1]
            i += 1
        while j < len(taken) and taken[j][1] <= start:
            j += 1
        if start > until and start > last + 2 or j < len(taken) and taken[j][0] < end or not _mixed.search(m[0]):
            continue
        surroundings = text[end : end + AROUND] + text[max(0, start - AROUND) : start]
        if novelty.added(surroundings, m[0]) >= NOVEL * (end - start):
            out.append((start, 3, end))
            last = end
    return out


def spans_of(data: bytes, novelty: Novelty) -> list[dict]:
    """All spans of a text by start, then kind."""
    low = data.lower()
    after = any(w in low for w in _SENSITIVE_BYTES)
    if not (after or b"AKIA" in data or b"x" * MIN_HEX in data.translate(_HEX_MASK)):
        return []
    text = data.decode("utf-8", "replace")
    spans = base_spans(text)
    if after:
        spans += novel_spans(text, spans, novelty)
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]


def scan_secrets(docs: DataFrame, dictionary: bytes, into: str = "secrets") -> DataFrame:
    """``docs`` with the array ``into`` of (kind, start, end), by start, then kind."""

    @F.arrow_udf(SPANS)
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(dictionary)
        for texts in parts:
            yield pa.array([spans_of(t.as_py() or b"", novelty) for t in texts], _SPAN)

    return docs.withColumn(into, scan(F.col("text").cast("binary")))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every document."""
    found = scan_secrets(docs.select("doc_id", "text"), identifier_dictionary(docs))
    all_spans = F.col("secrets")
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(all_spans, lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(all_spans).alias("spans"),
        count("novel").alias("n_novel"),
    )
