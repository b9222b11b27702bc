"""Operator 11: cuts against a plain split, round trips, awkward rows."""

import hashlib
import random
import re

import duckdb
import pytest
from helpers import EDGE_ROWS, EDGE_SCHEMA, SF, edge, empty
from pyspark.sql import functions as F

from perigee.llm import fim
from perigee.llm.queries import QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_rule(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    hx = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hx[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1024])
def test_every_cut_of_odd_texts(block):
    rnd = random.Random(block)
    for _ in range(40):
        text = "".join(rnd.choice("abZ z\n0é漢\U0001f600") * rnd.choice((1, 1, 9)) for _ in range(rnd.randrange(60)))
        data, units = text.encode(), UNIT.findall(text)
        tree = fim.BlockTree(data, block)
        assert (tree.n_units, tree.n_chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_a_unit_over_many_blocks():
    data = b"x" * 10_000 + b"1" + b"y" * 5_000
    tree = fim.BlockTree(data, 16)
    assert [tree.cut(k) for k in range(4)] == [(0, 0), (10_000, 10_000), (10_001, 10_001), (15_001, 15_001)]


def test_query_against_the_rule(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = {r["doc_id"]: r for r in QUERIES["op11_fill_in_middle"](spark, SF).collect()}
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in docs:
        n, form, p, m, out = plain_rule(d, t)
        r = rows[d]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(out), sha(t or ""))
    assert {r["form"] for r in rows.values()} == {"plain", "psm", "spm"}


def test_awkward_rows(spark):
    out = fim.fill_in_middle(edge(spark))
    assert out.columns == [*edge(spark).columns, "fim"]
    rows = out.select("doc_id", "text", "fim.*", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(rows) == len(EDGE_ROWS)
    for r in rows:
        assert tuple(r[2:7]) == plain_rule(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert fim.fill_in_middle(empty(spark)).collect() == []


def test_markers_and_halves_of_markers(spark):
    texts = ["<P>", "a <M> b", "<S", "S>", "<<<S>", "<S><P>", "< P> <" * 50, "P>M>S>" * 40, "<" * 30, ">" * 30]
    rows = [(i, t) for i, t in enumerate(texts * 20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fim.fill_in_middle(d).select("doc_id", "text", "fim.*", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back"))
    for r in got.collect():
        assert tuple(r[2:7]) == plain_rule(r["doc_id"], r["text"]) and r["back"] == r["text"]


def test_a_column_of_that_name_is_replaced(spark):
    d = spark.createDataFrame([(1, "a b", "old")], "doc_id bigint, text string, fim string")
    out = fim.fill_in_middle(d)
    assert out.columns == ["doc_id", "text", "fim"] and out.select("fim.n").first()[0] == 3
    assert EDGE_SCHEMA and fim.fim_report(d).count() == 1
