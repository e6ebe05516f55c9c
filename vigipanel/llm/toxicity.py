"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses.  A weighted lexicon transducer turns each token into
a symbol (insult with a weight, threat, target, negation, report, other); the
lexicon is a prefix tree whose weights are log-odds learned from labelled rows.
Scope transducers then rewrite the symbols of a clause one after the other: an
insult shortly after a negation becomes a negated one, one after a verb of
saying or inside quotes a reported one, one in a clause with a target a directed
one; likewise for threats.  What is summed up and scored are those matched
clauses, by a logistic model over the kinds of match, also learned from labels.

``FIT_ROWS`` labelled rows at most (those first by a hash of doc_id) are used to
fit; rows with crc32(doc_id) mod 5 = 0 never are.

Edge cases: a null or empty text matches nothing and gets the score of an
unmatched text.  Without labelled rows of both kinds the lexicon is empty and
every score is the smoothed share of label 1 (0.5 without any row).  Repeated
rows each get their score; an empty table gives an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FIT_ROWS = 30_000
LEXICON_ENTRIES = 5_000        # the model's size
PREFIXES = (4, 5, 6)
LEAST_BOUND = 1.5              # log-odds less two standard errors

TARGETS = frozenset("you your yours yourself u he him she her they them du dich dir dein deine ihr euch sie tu te toi ton ta vous votre il elle eux tú ti tuyo usted ustedes vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never nobody none nicht kein keine keinen niemals nie ne pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say wrote writes quoted quote called according reported sagte sagt schrieb zitiert laut dit disait écrit cité selon dijo dice escribió según citado".split())
THREATS = frozenset("kill hurt destroy burn shoot stab beat murder töten schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split())
KINDS = ("plain", "directed", "negated", "reported", "threat", "threat_directed", "threat_negated", "threat_reported")
NEGATION_REACH = 3

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»]")
_ENDS = frozenset(".!?;\n")
_QUOTES = frozenset("\"“”«»")


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)     # "word$" for whole words, else prefixes
    weights: tuple[float, ...] = (0.0,) * (len(KINDS) + 1)
    bias: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lexical(token: str, lexicon: dict[str, float]) -> tuple[str, float]:
    """The lexicon transducer: one token to one weighted symbol."""
    weight = lexicon.get(token + "$", 0.0)
    for n in PREFIXES:
        weight = max(weight, lexicon.get(token[:n], 0.0)) if len(token) >= n else weight
    if weight > 0:
        return "insult", weight
    for symbol, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
        if token in words:
            return symbol, 1.0
    return ("quote" if token in _QUOTES else "other"), 0.0


def negation_scope(clause: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Insults and threats within ``NEGATION_REACH`` symbols of a negation are negated."""
    out, left = [], 0
    for symbol, weight in clause:
        out.append((symbol + "_negated" if left and symbol in ("insult", "threat") else symbol, weight))
        left = NEGATION_REACH if symbol == "negation" else max(0, left - 1)
    return out


def report_scope(clause: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """After a verb of saying, or between quotes, insults and threats are reported ones."""
    out, said, quoted = [], False, False
    for symbol, weight in clause:
        quoted ^= symbol == "quote"
        said |= symbol == "report"
        out.append((symbol + "_reported" if (said or quoted) and symbol in ("insult", "threat") else symbol, weight))
    return out


def target_scope(clause: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """In a clause that names a target, plain insults and threats are directed."""
    if not any(symbol == "target" for symbol, _ in clause):
        return clause
    return [(symbol + "_directed" if symbol in ("insult", "threat") else symbol, weight) for symbol, weight in clause]


_KIND = {f"{a}{b}": k for a, b, k in (
    ("insult", "", "plain"), ("insult", "_directed", "directed"), ("insult", "_negated", "negated"), ("insult", "_reported", "reported"),
    ("threat", "", "threat"), ("threat", "_directed", "threat_directed"), ("threat", "_negated", "threat_negated"), ("threat", "_reported", "threat_reported"),
)}


def matches(text: str | None, lexicon: dict[str, float], heads: frozenset[str]) -> np.ndarray:
    """Log of one plus the summed weights of each kind of matched clause, and the largest weight."""
    sums, most = dict.fromkeys(KINDS, 0.0), 0.0
    tokens = _TOKEN.findall((text or "").lower())
    done = -1
    for i in [i for i, t in enumerate(tokens) if t[:3] in heads]:
        if i <= done:
            continue
        first = i
        while first > 0 and tokens[first - 1] not in _ENDS:
            first -= 1
        last = i
        while last + 1 < len(tokens) and tokens[last + 1] not in _ENDS:
            last += 1
        done = last
        clause = target_scope(report_scope(negation_scope([lexical(t, lexicon) for t in tokens[first:last + 1]])))
        for symbol, weight in clause:
            kind = _KIND.get(symbol)
            if kind:
                sums[kind] += weight
                most = max(most, weight)
    return np.array([math.log1p(sums[k]) for k in KINDS] + [most])


def _heads(lexicon: dict[str, float]) -> frozenset[str]:
    return frozenset(w[:3].rstrip("$") for w in lexicon) | frozenset(w[:3] for w in THREATS)


def _matrix(texts: pd.Series, lexicon: dict[str, float]) -> np.ndarray:
    heads = _heads(lexicon)
    return np.array([matches(t, lexicon, heads) for t in texts]).reshape(len(texts), len(KINDS) + 1)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic of at most ``rows`` labelled rows outside the held-out fold."""
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Lexicon weights and clause weights from labelled rows."""
    sample = labelled(docs, labels, rows)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    prior = math.log((bad + 0.5) / (good + 0.5))
    if not bad or not good:
        return Model(bias=prior)
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("word"))
    words = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    entries = words.select("bad", "good", F.explode(F.array_union(
        F.array(F.concat("word", F.lit("$"))),
        F.transform(F.filter(F.array(*[F.lit(n) for n in PREFIXES]), lambda n: F.length("word") >= n), lambda n: F.substring(F.col("word"), F.lit(1), n)),
    )).alias("entry")).groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = entries.where((F.col("bad") >= 5) & (odds - 2 * error > LEAST_BOUND)).select("entry", F.round(odds, 6).alias("weight"), (F.col("bad") * odds).alias("gain"))
    lexicon = {r["entry"]: r["weight"] for r in best.orderBy(F.desc("gain"), "entry").limit(LEXICON_ENTRIES).collect()}

    def features(batches):
        for batch in batches:
            matrix = _matrix(batch["text"], lexicon)
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int64"), "f": list(matrix)})

    held = sample.mapInPandas(features, "toxic long, f array<double>").toPandas()      # at most FIT_ROWS short rows
    held = held.assign(key=[tuple(x) for x in held["f"]]).sort_values(["key", "toxic"])
    weights = _logistic(np.array(held["f"].tolist()), held["toxic"].to_numpy(float))
    return Model(lexicon, tuple(weights[1:]), float(weights[0]))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, turns: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the bias, which is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    shrink = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(model: Model):
    """A column function: text to a score from 0 to 1."""
    weights, bias = np.array(model.weights), model.bias

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        matrix = _matrix(texts, model.lexicon)
        return pd.Series(1 / (1 + np.exp(-np.clip(matrix @ weights + bias, -30, 30))))

    return scored


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
