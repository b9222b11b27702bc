"""Operator 5, PII: detected entities get keyed surrogates of the same type and shape.

1. One alternation finds entities in the whole text (emails, IP addresses, phone and card
   numbers, social-security numbers, IBANs, secrets, persons named with a title).  A cheap test
   for digits, ``@`` or a title comes first, so that most texts are scanned once.
2. Every distinct entity of the corpus gets a surrogate: a function of key, type, canonical
   form and attempt.  It keeps type, length, punctuation, letter case and script; an email keeps
   its top domain, and one domain always becomes the same domain; an address stays a valid
   address; a phone keeps its country code; a card keeps its first digit and its Luhn validity;
   a person keeps the titles, and the name keeps gender and script.  The gender is that of the
   titles or else of a known given name, or neutral; an IPv6 address keeps its zero groups.  Family names
   have surrogates of their own, so "Mr Smith", "Dr. Smith" and "Mr John Smith" stay of one name.
3. Collision check over all distinct entities: a surrogate must differ from those of all other
   entities and from every entity that occurs in the corpus.  Losers (all but the least canonical
   form) try again with the next attempt; after ``ATTEMPTS`` tries an entity takes a tag with its
   digest.  So distinct entities stay distinct, and mentions of one entity (also in another
   case, or with other separators) stay one.
   A later attempt has more to choose from (another syllable, another given name behind a hyphen).
4. Texts are put together again from the pieces between matches and the surrogates.

Entities are made distinct before the shuffle, so a frequent entity is one row; texts without
entities are never shuffled.  Repeats in the patterns are bounded: of a mail domain of over 65 parts the first 65 are
the address, of more than five titles in a row the last five belong to the person.  Null and empty texts stay as they are; null doc_ids and repeated
rows are each rewritten; an empty table gives an empty result; other columns pass untouched
(``surrogate_pii``; ``n_chars``, where present, follows the new text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import ascii_lower, let, packed, written

ATTEMPTS = 8
KEY = "surrogate-key"

# Titles that announce a person, by gender (the last: either).
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Signora", "Госпожа", "Κυρία"]
TITLES_M = ["Mr", "Herr", "Señor", "Monsieur", "Signor", "Господин", "Κύριος"]
TITLES_N = ["Dr", "Prof", "Doctor", "Professor", "Mx"]
# Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin_f": ["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia"],
    "latin_m": ["Adam", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oskar", "Paul"],
    "latin_n": ["Alex", "Charlie", "Chris", "Jamie", "Kim", "Noel", "Robin", "Sam", "Sascha", "Toni"],
    "cyrillic_f": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    "cyrillic_m": ["Антон", "Борис", "Виктор", "Иван", "Лев", "Михаил", "Олег", "Павел"],
    "cyrillic_n": ["Валя", "Женя", "Саша", "Слава", "Шура"],
    "greek_f": ["Άννα", "Ελένη", "Ζωή", "Μαρία", "Νίκη", "Σοφία"],
    "greek_m": ["Αντώνης", "Γιώργος", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"],
    "greek_n": ["Αλέξ", "Κρις", "Νικ", "Τόνι"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gor", "hal", "kin", "lor", "mar", "nes", "pol", "rin", "sel", "tan", "ver", "wil", "zan"],
    "cyrillic": ["ба", "вер", "гор", "дан", "зел", "кол", "лан", "мир", "нов", "пол", "рин", "сер", "тар", "фед", "хол", "чер"],
    "greek": ["βα", "γαλ", "δημ", "ζαν", "καλ", "λου", "μαν", "νικ", "παπ", "ρεν", "σαρ", "ταρ", "φιλ", "χαρ", "ψαλ", "θεο"],
}
# Letters that stand for letters of the same script.
ALPHABETS = [
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9]", "0123456789"),
    ("[ß-öø-ÿ]", "àáâãäåæçèéêëìíîïñòóôõöùúûüý"),
    ("[À-ÖØ-Þ]", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"),
    ("[а-я]", "абвгдежзиклмнопрстуфхцчшщэюя"),
    ("[А-Я]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
    ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
]

ONE_TITLE = "(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")\.?"
# bounded repeats: the regex engine recurses through unbounded groups and would overflow its stack
TITLE = f"{ONE_TITLE}(?: {ONE_TITLE}){{0,4}}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,63}\.\p{L}{2,}"
IPV4 = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\p{N}|\.\d)"
GROUPS = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
IPV6 = (
    r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[0-9A-Fa-f:]{0,80}(?:\d|[A-Fa-f]:[A-Fa-f]))" + GROUPS + "::" + GROUPS + r")(?![\p{L}\p{N}:]|\.\d)"  # a::b alone is a name
)
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|(?<!\d[ .,-])\d{3} \d{3} \d{4}(?! ?\d)"
    r"|(?<!\d[ .,-])(?=0(?: ?\d){8,11}(?! ?\d))0\d{1,4}(?: \d{2,4}){2,4})(?!\p{N})"
)
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
SECRET = (
    r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![\p{L}\p{N}])"
    r"""|(?<=\b(?i:token|secret|password|passwd|api[_-]?key)["']?\s{0,2}[:=]\s{0,2}["']?)[A-Za-z0-9+/_-]{8,}"""
)
NO_TITLE = "(?!(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")(?!\p{L}))"  # a title is no name
PERSON = r"(?<!\p{L})" + TITLE + " " + NO_TITLE + r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"
ENTITY = "|".join([EMAIL, SECRET, IPV4, IPV6, SSN, PHONE, IBAN, CARD, PERSON])
HINT = r"[@0-9]|::|(?i:token|secret|passw|api[_-]?key)|(?<!\p{L})" + TITLE + " "


def kind_of(raw: Column) -> Column:
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike(f"^{TITLE} "), "person")
        .when(raw.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4")
        .when(raw.rlike(r"^[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*$"), "ipv6")
        .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(raw.rlike(r"^(?:\+\d|\()|^\d{3}[-. ]\d{3}[-. ]\d{4}$"), "phone")
        .when(raw.rlike(r"^0\d{1,4}(?: \d{2,4}){2,4}$") & (F.length(digits(raw)) < 13), "phone")
        .when(raw.rlike(r"^\d[\d -]{12,}$"), "card")
        .when(raw.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
        .otherwise("secret")
    )


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def ipv6_ends(raw: Column) -> tuple[Column, Column]:
    """Groups of an address before and after ``::`` (all before, if it has none)."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    after = F.when(raw.contains("::"), F.substring_index(raw, "::", -1)).otherwise("")
    return groups(F.substring_index(raw, "::", 1)), groups(after)


def canonical(kind: Column, raw: Column) -> Column:
    """The form by which mentions of one entity agree."""
    code = F.regexp_extract(raw, r"^\+(\d{1,3})", 1)
    name = F.regexp_replace(raw, f"^{TITLE} ", "")
    titles = F.regexp_extract(raw, f"^{TITLE} ", 0)
    titled = lambda ts: titles.rlike(r"(?<!\p{L})(?:" + "|".join(ts) + r")\.? ")
    given = F.initcap(F.substring_index(name, " ", 1))
    called = lambda g: given.isin([x for k, v in GIVEN.items() if k.endswith(g) for x in v]) & name.contains(" ")
    gender = (
        F.when(titled(TITLES_F), "f|").when(titled(TITLES_M), "m|").when(called("_f"), "f|").when(called("_m"), "m|").otherwise("n|")
    )
    before, after = ipv6_ends(raw)
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(before) - F.size(after))
    ipv6 = F.array_join(F.transform(F.concat(before, zeros, after), lambda g: F.lpad(F.lower(g), 4, "0")), ":")
    return (
        F.when(kind == "email", ascii_lower(raw))
        .when(kind == "ipv6", ipv6)
        .when(kind == "phone", F.concat(code, F.lit("|"), F.substr(digits(raw), F.length(code) + 1)))
        .when(kind.isin("card", "ssn"), digits(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "person", F.concat(gender, F.initcap(name)))
        .otherwise(raw)
    )


def keyed(seed: Column, i: Column) -> Column:
    """31 keyed bits for place ``i``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, i.cast("string"))), 1, 7), 16, 10).cast("bigint")


def swapped(s: Column, seed: Column) -> Column:
    """Each letter or digit replaced by one of the same script and case; the rest kept."""

    def swap(c: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for cls, letters in ALPHABETS:
            pick = F.substr(F.lit(letters), (keyed(seed, i) % len(letters) + 1).cast("int"), F.lit(1))
            out = F.coalesce(out, F.when(c.rlike(f"^{cls}$"), pick))
        return F.coalesce(out, c)

    return F.array_join(F.transform(F.split(s, ""), swap), "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    n = F.length(number)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + let(
            F.substr(number, i, F.lit(1)).cast("int"),
            lambda d: F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
    )


def surrogate(kind: Column, canon: Column, attempt: int, key: str, family: Column) -> Column:
    """Canonical form of the surrogate of an entity; ``family`` is the surrogate of a person's family name."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, F.lit(str(attempt)))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(
        swapped(local, seed), F.lit("@"), swapped(host, F.concat_ws("|", F.lit(key), F.lit("domain"), domain)), F.lit("."), top
    )
    octet = lambda o, i: (
        F.when(F.length(o) == 1, keyed(seed, i) % 10)
        .when(F.length(o) == 2, keyed(seed, i) % 90 + 10)
        .otherwise(keyed(seed, i) % 156 + 100)
        .cast("string")
    )
    ipv4 = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    hexed = F.array_join(
        F.transform(
            F.split(canon, ""),
            lambda c, i: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(keyed(seed, i) % 16)))
            .when(c.rlike("[A-F]"), F.hex(keyed(seed, i) % 16))
            .otherwise(c),
        ),
        "",
    )
    # zeros at the start of a group stay, so that every short form of the address has one of the surrogate
    ipv6 = F.array_join(
        F.transform(
            F.split(canon, ":"),
            lambda g, i: let(
                F.regexp_replace(g, "^0+", ""),
                lambda body: F.when(body == "", g).otherwise(
                    F.lpad(
                        F.array_join(
                            F.transform(
                                F.split(body, ""),
                                lambda c, j: F.lower(
                                    F.hex(F.when(j == 0, keyed(seed, 4 * i) % 15 + 1).otherwise(keyed(seed, 4 * i + j) % 16))
                                ),
                            ),
                            "",
                        ),
                        4,
                        "0",
                    )
                ),
            ),
        ),
        ":",
    )
    phone = F.concat(
        F.substring_index(canon, "|", 1), F.lit("|"), swapped(F.substring_index(canon, "|", -1), seed)
    )
    card = let(
        F.concat(F.substr(canon, F.lit(1), F.lit(1)), swapped(F.substr(canon, F.lit(2)), seed)),
        lambda s: F.when(luhn_sum(canon) % 10 != 0, s).otherwise(
            let(
                F.concat(F.substr(s, F.lit(1), F.length(s) - 1), F.lit("0")),
                lambda z: F.concat(
                    F.substr(z, F.lit(1), F.length(z) - 1), ((10 - luhn_sum(z) % 10) % 10).cast("string")
                ),
            )
        ),
    )
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), swapped(F.substr(canon, F.lit(3)), seed))
    name = F.substr(canon, F.lit(3))
    script = lambda s: F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    given_of = F.create_map(*[x for k, v in GIVEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parts_of = F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    pick = lambda a, i: F.get(a, (keyed(seed, F.lit(i)) % F.size(a)).cast("int"))
    # a later attempt has more to choose from: one more syllable, one more given name behind a hyphen
    new_family = F.initcap(F.concat(*[pick(parts_of[script(canon)], i) for i in range(4 + attempt)]))
    names = given_of[F.concat(script(name), F.lit("_"), F.substr(canon, F.lit(1), F.lit(1)))]
    given = F.concat_ws("-", *[pick(names, 9 + i) for i in range(1 + attempt)])
    person = F.concat(
        F.substr(canon, F.lit(1), F.lit(2)), F.when(name.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)
    )
    plain_hex = canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv4", ipv4)
        .when(kind == "ipv6", ipv6)
        .when((kind == "secret") & plain_hex, hexed)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "person", person)
        .when(kind == "family", new_family)
        .otherwise(swapped(canon, seed))
    )


def rendered(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate in the format of a mention: its separators, title and letter case."""

    def refill(filled: Column) -> Column:
        """Digits (letters) of ``filled`` in the places of those of ``raw``."""
        chars = F.split(raw, "")
        return F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(~c.rlike("[0-9A-Z]"), c).otherwise(
                    F.substr(
                        filled,
                        F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^0-9A-Z]", "")),
                        F.lit(1),
                    )
                ),
            ),
            "",
        )

    cased = F.array_join(
        F.transform(
            F.split(new, ""), lambda c, i: F.when(F.substr(raw, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)
        ),
        "",
    )
    before, after = ipv6_ends(raw)
    all_groups = F.split(new, ":")
    cut = lambda g, k: F.substr(F.get(all_groups, k), F.lit(5) - F.length(g))  # noqa: E731  as long as in the mention
    short = F.concat(
        F.array_join(F.transform(before, lambda g, i: cut(g, i)), ":"),
        F.when(raw.contains("::"), "::").otherwise(""),
        F.array_join(F.transform(after, lambda g, i: cut(g, F.lit(8) - F.size(after) + i)), ":"),
    )
    title = F.regexp_extract(raw, f"^{TITLE} ", 0)
    name = F.substr(new, F.lit(3))
    loud = (F.upper(raw) == raw) & (F.lower(raw) != raw)
    return (
        F.when(new.startswith("<"), new)
        .when(kind == "email", cased)
        .when(kind == "ipv6", F.when(raw.rlike("[A-F]") & ~raw.rlike("[a-f]"), F.upper(short)).otherwise(short))
        .when(kind == "phone", refill(F.regexp_replace(new, r"\|", "")))
        .when(kind.isin("card", "ssn", "iban"), refill(new))
        .when(kind == "person", F.concat(title, F.when(loud, F.upper(name)).otherwise(name)))
        .otherwise(new)
    )


def assigned(entities: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, canon, new) for distinct ``entities`` (kind, canon).

    Family names get their surrogates first and each person then takes that of their family, so mentions of
    one family under several titles or given names keep one name."""
    person = F.col("kind") == "person"
    named = entities.withColumn("own", F.when(person, F.substring_index(F.substr("canon", F.lit(3)), " ", -1)))
    named = written(named, "pii-entities")
    families = named.where(person).select(F.lit("family").alias("kind"), F.col("own").alias("canon")).distinct()
    families = _distinct_surrogates(families.withColumn("family", F.lit(None).cast("string")), key, attempts)
    families = families.select(F.col("canon").alias("own"), F.col("new").alias("family"))
    return _distinct_surrogates(named.join(families, "own", "left").select("kind", "canon", "family"), key, attempts)


def _distinct_surrogates(entities: DataFrame, key: str, attempts: int) -> DataFrame:
    """(kind, canon, new) of ``entities`` (kind, canon, family): the collision check."""
    entities = written(entities, "pii-entities")
    todo, done = entities, None
    for attempt in range(attempts):
        tried = todo.withColumn("new", surrogate(F.col("kind"), F.col("canon"), attempt, key, F.col("family")))
        used = entities.select("kind", F.col("canon").alias("new"))
        if done is not None:
            used = used.unionByName(done.select("kind", "new"))
        used = used.distinct().withColumn("used", F.lit(True))
        tried = tried.withColumn("place", F.expr("row_number() OVER (PARTITION BY kind, new ORDER BY canon)"))
        tried = tried.join(used, ["kind", "new"], "left").select(
            "kind", "canon", "family", "new", (F.col("used").isNull() & (F.col("place") == 1)).alias("free")
        )
        tried = written(tried, "pii-surrogates")
        good = tried.where("free").select("kind", "canon", "new")
        done = good if done is None else done.unionByName(good)
        todo = tried.where(~F.col("free")).select("kind", "canon", "family")
        if todo.isEmpty():
            return done
    tag = F.concat(F.lit("<"), F.col("kind"), F.lit("-"), F.md5(F.concat_ws("|", F.lit(key), F.col("kind"), F.col("canon"))), F.lit(">"))
    return done.unionByName(todo.select("kind", "canon", tag.alias("new")))


def rewritten(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(row, kinds): the rows of ``docs`` with ``text`` rewritten, and the kind of each entity replaced (empty if
    none).  Texts are searched once and written with what was found."""
    text = F.col("row")["text"]
    none = F.array().cast("array<string>")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)
    spotted = written(packed(docs).select("row", F.coalesce(found, none).alias("found")), "pii-found")
    plain = spotted.where(F.size("found") == 0).select("row", none.alias("kinds"))
    private = spotted.where(F.size("found") > 0).select(
        "row", "found", F.col("row")["doc_id"].alias("id"), F.md5(text).alias("text_key")
    )
    mentions = (
        private.select("id", "text_key", F.posexplode("found").alias("pos", "raw"))
        .withColumn("kind", kind_of(F.col("raw")))
        .withColumn("canon", canonical(F.col("kind"), F.col("raw")))
    )
    mentions = written(mentions, "pii-mentions")
    mapping = assigned(mentions.select("kind", "canon").distinct(), key)
    news = (
        mentions.join(mapping, ["kind", "canon"])
        .withColumn("out", rendered(F.col("kind"), F.col("raw"), F.col("new")))
        .groupBy(F.col("id").alias("id2"), F.col("text_key").alias("key2"))
        .agg(F.array_sort(F.collect_set(F.struct("pos", "out", "kind"))).alias("news"))
    )
    pieces = F.split(text, ENTITY)
    joined = private.join(news, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_key") == F.col("key2")))
    new_text = let(
        F.struct(pieces.alias("p"), F.col("news").alias("n")),
        lambda x: F.array_join(
            F.transform(
                x.getField("p"),
                lambda piece, i: F.concat(piece, F.coalesce(F.get(x.getField("n"), i).getField("out"), F.lit(""))),
            ),
            "",
        ),
    )
    return plain.unionByName(joined.select(F.col("row").withField("text", new_text).alias("row"), F.col("news.kind").alias("kinds")))


def pii_report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (rewritten), n_entities, kinds (sorted, distinct)."""
    return rewritten(docs.select("doc_id", "text"), key).select(
        "row.doc_id",
        "row.text",
        F.size("kinds").cast("bigint").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"),
    )


def surrogate_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``n_chars`` follows, other columns stay."""
    out, row = rewritten(docs, key), F.col("row")
    if "n_chars" in docs.columns:
        length = F.length(row["text"]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("row", row.withField("n_chars", F.when(F.size("kinds") > 0, length).otherwise(row["n_chars"])))
    return out.select("row.*")
