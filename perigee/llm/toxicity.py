"""Operator 7, toxicity: a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, quotation mark, comma, other).
Small transducers rewrite the symbol string of a clause: negation marks insults and threats in its
scope, reported speech marks those it quotes, and the target transducer finds an insult beside a
person addressed and a threat against one.  They are composed into one machine, so a clause costs
one table step per word; clauses with a word of reporting are first read backwards by one more machine,
for speech that stands before it ("...", she said).  The outputs of a clause say which patterns it matched; a document's
features are the numbers of its clauses by pattern, and a logistic weight per pattern, learned
from the training rows, gives the score.

Learning uses only rows with crc32(doc_id as text) mod 5 <> 0:
* insults: a fixed seed list plus words of any language that occur in at least ``MIN_TEXTS`` and
  the share ``MIN_SHARE`` of the toxic training texts, and ``MIN_LIFT`` times as often (by share
  of texts) as in the others (below ``STRONG_LIFT`` they are slights, with a weight of their
  own); near copies, which share the least 3-word hash, count as one text;
  fitted on at most ``SAMPLE`` rows of each label;
* weights: all training rows are counted by (features, label) in Spark; a feature is the binary logarithm
  of 1 + its count, rounded down, so many matches weigh more than few and the collected table grows with the
  logarithm of the longest text, not with the rows; Newton's method fits it exactly.
The score sees nothing but the text.

Null and empty texts have no clause and get the score of a text without matches; null doc_ids
are never held out (their remainder is null) nor learned from; repeated rows are scored each;
repeated labels count each; without any label of one kind the score is 0.5 for a text with a
match and 0 without; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import window_hashes, written

# Words of the grammar's classes (English, German, French, Spanish).
INSULTS = """idiot idiots stupid moron morons loser losers scum trash garbage worthless pathetic disgusting clown dumb
fool imbecile jerk bastard dummkopf trottel versager abschaum widerlich wertlos crétin abruti minable ordure
imbécil estúpido estúpida inútil basura asqueroso""".split()
THREATS = """kill hurt destroy beat stab shoot burn crush punish töten umbringen verletzen zerstören tuer frapper
détruire matar golpear destruir""".split()
TARGETS = """you your yours yourself u he she they him her them du dich dir dein deine ihr euch sie tu toi te vous
votre ton ta tú usted ustedes ellos""".split()
NEGATIONS = """not no never neither nor nobody without isn't aren't wasn't don't doesn't won't nicht kein keine nie
niemals pas jamais aucun ni nunca jamás sin""".split()
REPORTS = """said says say told wrote writes claimed claims called quoted reported according sagte sagt schrieb
behauptete dit disait écrit déclaré dijo dice escribió""".split()

FEATURES = ("insult", "slight", "aimed", "negated", "reported", "threat", "loose")
SCOPE = 3  # words that a negation or an address reaches
MIN_SHARE = 0.006
MIN_TEXTS = 5
MIN_LIFT = 20
STRONG_LIFT = 400
SAMPLE = 5000

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"'“”„«»,]")
MARKS = dict.fromkeys("\"'“”„«»", "Q") | {",": "C"}
# a clause ends at a stop, but not at one right before a closing quotation mark; a colon does not end it
CLAUSE = re.compile(r"(?:[.!?;]+(?![\"'”».!?;])|\n)+")


class Transducer:
    """Deterministic transducer: step(state, symbol) -> (state, output); unknown symbols pass."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: this machine's output is the other's input."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: str) -> dict:
        """(state number, symbol) -> (state number, output) of all reachable states."""
        number, rows, todo = {self.start: 0}, {}, [self.start]
        while todo:
            state = todo.pop()
            for s in symbols:
                nxt, out = self.step(state, s)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                rows[number[state], s] = (number[nxt], out)
        return rows


def negation() -> Transducer:
    """I, J, T within SCOPE words after N become n (negated)."""

    def step(left, s):
        if s == "N":
            return SCOPE, "W"
        return max(left - 1, 0), "n" if left and s in "IJT" else s

    return Transducer(0, step)


def reported_speech() -> Transducer:
    """I, J, T after R become r (reported): to the end of the quotation that follows R, or of the clause."""

    def step(state, s):
        if s == "R":
            return (state if state == "quoted" else "named"), "W"
        if s == "Q":
            return {"named": "quoted", "quoted": "off"}.get(state, "off"), s
        return state, "r" if state != "off" and s in "IJT" else s

    return Transducer("off", step)


def reported_before() -> Transducer:
    """As ``reported_speech`` for speech that stands before its R; reads a clause backwards.  R must follow a
    quotation mark or a comma within ``SCOPE`` words; a quotation ends at its other mark."""

    def step(state, s):
        where, left = state
        if s == "R" and where == "off":
            return ("near", SCOPE), "W"
        if where == "near":
            if s in "QC":
                return ("quoted" if s == "Q" else "open", 0), s
            return (("near", left - 1) if left else ("off", 0)), s
        if s == "Q" and where == "quoted":
            return ("off", 0), s
        return state, "r" if where != "off" and s in "IJT" else s

    return Transducer(("off", 0), step)


def target() -> Transducer:
    """Y near I or J: A (aimed insult); T before Y: K (threat); outputs come at the second of the two."""

    def step(state, s):
        y, i, t = (max(x - 1, 0) for x in state)
        if s == "Y":
            return (SCOPE, i, 0), "K" if state[2] else "A" if state[1] else "W"
        if s in "IJ":
            return (y, SCOPE, t), "A" if state[0] else s
        if s == "T":
            return (y, i, SCOPE), "T"
        return (y, i, t), s

    return Transducer((0, 0, 0), step)


SYMBOLS = "IJTYNRWQC"
BACKWARDS = reported_before().table(SYMBOLS)
MACHINE = negation().then(reported_speech()).then(target()).table(SYMBOLS + "r")
OUTPUT = {"I": 0, "J": 1, "A": 2, "n": 3, "r": 4, "K": 5, "T": 6}


def symbols_of(learned: dict[str, bool]) -> dict[str, str]:
    """Symbol of each word; learned: word -> whether it is a strong insult."""
    classes = [("J", learned), ("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS), ("I", INSULTS)]
    out = {w: s for s, ws in classes for w in ws}
    return out | {w: "I" for w, strong in learned.items() if strong} | MARKS


def clause_counts(text: str, symbols: dict[str, str], trigger: re.Pattern) -> list[int]:
    """Number of clauses that match each pattern; a clause counts once, for its gravest patterns."""
    counts = [0] * len(FEATURES)
    low = text.lower()
    if not trigger.search(low):
        return counts
    for clause in CLAUSE.split(low):
        if not trigger.search(clause):
            continue
        string = [symbols.get(w, "W") for w in WORD.findall(clause)]
        if "R" in string:
            state = 0
            for i in range(len(string) - 1, -1, -1):
                state, out = BACKWARDS[state, string[i]]
                # R stays for the forward machine
                string[i] = "R" if string[i] == "R" else out
        state, seen = 0, set()
        for s in string:
            state, out = MACHINE[state, s]
            if out in OUTPUT:
                seen.add(out)
        if "A" in seen:
            seen -= {"I", "J"}
        if "K" in seen:
            seen.discard("T")
        for out in seen:
            counts[OUTPUT[out]] += 1
    return counts


def features(docs: DataFrame, learned: dict[str, bool]) -> DataFrame:
    """doc_id and the clause counts of every whole text."""
    symbols = symbols_of(learned)
    heads = sorted({w for w, s in symbols.items() if s in "IJT"}, key=lambda w: (-len(w), w))
    pattern = r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, heads)) + r")(?![^\W\d_])"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger = re.compile(pattern)
        for part in parts:
            rows = [clause_counts(t or "", symbols, trigger) for t in part.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *FEATURES])

    schema = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FEATURES)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, schema)


def remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def learned_insults(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, bool]:
    """Words frequent in toxic training texts and rare in the others, and whether they are strong.

    Fitted on at most ``sample`` rows of each label (those with the least md5 of doc_id), and at
    most 1 / MIN_SHARE times the mean number of distinct words of a toxic text pass the first
    test.  Both bound what reaches the driver and the broadcast of sampled ids.
    """
    train = labels.where(remainder() != 0).select("doc_id", "toxic").distinct()
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [train.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    ws = F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "")
    listed = written(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .select("toxic", F.coalesce(F.array_min(window_hashes(ws, 3)), F.xxhash64("text")).alias("copy"), F.array_distinct(ws).alias("ws"))
        .dropDuplicates(["toxic", "copy"]),
        "toxicity-sample",
    )
    totals = {r["toxic"]: r["count"] for r in listed.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_other:
        return {}
    counted = (
        listed.select("toxic", F.explode("ws").alias("w")).groupBy("w")
        .agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
        .where(F.col("a") >= max(MIN_TEXTS, MIN_SHARE * n_toxic))
        .where(F.col("a") * n_other >= MIN_LIFT * (F.col("b") + 1) * n_toxic)
    )
    strong = lambda a, b: a * n_other >= STRONG_LIFT * (b + 1) * n_toxic
    return {r["w"]: strong(r["a"], r["b"]) for r in counted.orderBy("w").collect()}


def fit(rows: list[tuple[list[int], int, int]], ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights (bias first) of (features, label, count) rows by Newton's method."""
    x = np.array([[1.0, *r[0]] for r in rows])
    y = np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (pen * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (n * (y - p)) - pen * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the clause counts of every document."""
    found = written(features(docs, learned_insults(docs, labels)), "toxicity")  # read by the fit and by the scores
    # the number of binary digits of 1 + count, less one: exact for every count
    binned = [(F.length(F.bin(F.col(f) + 1)) - 1).alias(f) for f in FEATURES]
    train = labels.where(remainder() != 0).where("toxic IN (0, 1)").select("doc_id", "toxic")
    table = found.join(train, "doc_id").select(*binned, "toxic").groupBy(*FEATURES, "toxic").count().collect()
    rows = [([r[f] for f in FEATURES], r["toxic"], r["count"]) for r in table]
    if {r[1] for r in rows} == {0, 1}:
        w = fit(rows)
        z = F.lit(float(w[0]))
        for f, v in zip(binned, w[1:]):
            z = z + f * F.lit(float(v))
        score = 1 / (1 + F.exp(-z))
    else:
        matched = F.greatest(*[F.col(f) for f in FEATURES]) > 0
        score = F.when(matched, F.lit(0.5)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), score.alias("score"), *FEATURES
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
