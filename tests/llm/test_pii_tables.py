"""Operator 5 over a table: surrogates, collisions and coreference held against a plain reading of the texts;
texts that would overflow a recursive pattern; clashing columns."""

import duckdb
import pytest
import regex
from helpers import SF, SF_MID

from perigee.llm import decontam, neardup, pii, quality

ENTITY = regex.compile(pii.ENTITY)


def plain_canon(raw):
    """What mentions of one entity share, but for persons."""
    if "@" in raw:
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    bare = regex.sub("[^0-9]", "", raw)
    if raw.startswith("+"):
        code = regex.match(r"\+(\d{1,3})", raw)[1]
        return "phone" + code + "|" + bare[len(code):]
    return bare if regex.fullmatch(r"[0-9() .-]+", raw) and "." not in raw else raw


def replaced(text, new):
    """(entity, replacement) pairs of a text and its rewriting."""
    found = [m[0] for m in ENTITY.finditer(text)]
    pieces = ENTITY.split(text)
    out, at = [], len(pieces[0])
    assert new.startswith(pieces[0])
    for raw, piece in zip(found, pieces[1:], strict=True):
        end = new.index(piece, at + 1) if piece else len(new)
        out.append((raw, new[at:end]))
        at = end + len(piece)
    return out


@pytest.mark.parametrize("sf", [SF, SF_MID])
def test_whole_table(spark, sf):
    docs = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    rows = {r["doc_id"]: r for r in pii.pii_report(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert rows.keys() == docs.keys()
    mapping, everything = {}, set()
    for d, text in docs.items():
        found = ENTITY.findall(text or "")
        everything |= {plain_canon(x) for x in found}
        assert rows[d]["n_entities"] == len(found)
        if not found:
            assert rows[d]["text"] == text
            continue
        for raw, new in replaced(text, rows[d]["text"]):
            assert new != raw
            mapping.setdefault(plain_canon(raw), set()).add(plain_canon(new))
    assert len(mapping) > 15
    assert all(len(v) == 1 for v in mapping.values())  # coreference: one entity, one surrogate
    news = [next(iter(v)) for v in mapping.values()]
    assert len(set(news)) == len(news)  # distinct entities stay distinct
    assert not set(news) & everything  # and no surrogate is an entity of the corpus


def report(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["text"] for r in pii.pii_report(df).collect()}


def test_long_repeats_do_not_overflow(spark):
    dotted = "a@" + "bb." * 100_000 + "com"
    titles = "Dr " * 100_000 + "Anna Smith"
    colons = ":".join(["ab"] * 30_000)
    out = report(spark, dotted, titles, colons, "x" * 10_000 + "@y.com", "a.b" * 100_000)
    assert len(out[0]) == len(dotted) and out[0][:20] != dotted[:20]  # the first 65 parts are the address
    assert out[0][200:] == dotted[200:]
    assert out[1].startswith("Dr " * 99_995) and not out[1].endswith("Anna Smith")
    assert out[2] == colons and len(out[3]) == 10_006 and out[3][:9] != "x" * 9


def test_a_family_keeps_one_name(spark):
    out = report(spark, "Mr Smith met Dr. Smith and Mr John Smith, then Mrs Anna SMITH. Mr Jones and Prof. Jones left, so did Mr Adam Smith.")[0]
    words = regex.findall(r"(?:Mr|Mrs|Dr\.|Prof\.) (?:(\p{Lu}[\p{L}-]+) )?(\p{Lu}[\p{L}]+)", out)
    families = [w[1].lower() for w in words]
    assert len(words) == 7 and len({families[i] for i in (0, 1, 2, 3, 6)}) == 1 and families[4] == families[5] != families[0]
    assert "smith" not in families and "jones" not in families
    given = [w[0] for w in words]
    assert given[2] != given[6]  # two people of one family stay two
    assert given[0] == given[1] == ""


def test_many_people_of_one_family_stay_distinct(spark):
    people = [f"Mr {a}{b} Smith" for a in ("Xa", "Yo", "Zu", "Wi") for b in ("n", "m", "r", "l", "t", "s", "nd", "lf")]
    out = report(spark, *people)
    assert len(set(out.values())) == len(people) and len({v.split()[-1] for v in out.values()}) == 1


CLASH = "__key __kinds __found __doc __own __rows __news __key2 row id key many kinds found text_key size size2 news".split()


def test_no_column_name_clashes(spark):
    row = (1, "Mr Smith wrote to a@example.com " + " ".join(f"w{i}" for i in range(60)), "en", "s", 5, *[f"v{i}" for i in range(len(CLASH))])
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)
    d = spark.createDataFrame([row, (2, None, "en", "s", None, *["x"] * len(CLASH))], schema)
    bench = spark.createDataFrame([(1, "some other words that are not there at all")], "item_id bigint, text string")
    for f in (pii.surrogate_pii, neardup.drop_near_duplicates, quality.keep_clean, lambda x: decontam.drop_contaminated(x, bench)):
        out = f(d)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        for r in out.collect():
            assert tuple(r[5:]) == (row[5:] if r["doc_id"] == 1 else ("x",) * len(CLASH))
