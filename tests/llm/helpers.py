"""Awkward rows and plain re-implementations of the shared text rules."""

import re
from collections import Counter

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 997} tail" for i in range(15_000))
BASE = " ".join(f"alpha{i} beta{i} gamma{i}" for i in range(30))

# doc_id, text, lang, source, n_chars, and columns whose names an operator might use itself
EDGE_SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "n bigint, key string, block bigint, kept boolean, cls bigint, word string, size int"
)
EXTRA = (7, "k", 1, False, 3, "w", 5)
EDGE_ROWS = [
    (1, BASE, "en", "a", 1, *EXTRA),
    (2, BASE + " omega", "en", "a", 2, *EXTRA),
    (3, BASE, "en", None, 3, *EXTRA),
    (3, BASE, "en", None, 3, *EXTRA),  # a repeated row
    (4, None, "en", "a", None, *EXTRA),
    (5, "", None, "b", 0, *EXTRA),
    (6, " \t\n\r ", "de", "b", 5, *EXTRA),
    (7, LONG, "en", "b", None, *EXTRA),
    (None, BASE, None, None, None, *EXTRA),
    (None, None, None, None, None, *EXTRA),
    (8, "one two", "en", "a", 7, None, None, None, None, None, None, None),
    (9, "漢字 ▁ \U0001f600 ÀÉ x", "zh", "c", 9, *EXTRA),
]


def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text, width=5):
    w = words(lower(text))
    if not w:
        return []
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)]


def bag_similarity(a, b):
    a, b = Counter(a), Counter(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0
