"""Licence scans by a positional index of rare licence words.

Each licence template is a word sequence with a mandatory key phrase.  Document
frequencies of the templates' words are counted over all documents; the rarest
word of a key phrase is the phrase's entry in the index.  A document looks its
words up in the index only; each hit and posting fix where the template would
begin, so postings meet by relative position.  The key phrase must stand there
in full, and the share of the other template words found at their places is the
score.  No Python runs on this path, and only (document, hit) rows with a few
dozen words around the hit are ever built.

Edge cases: a null or empty text has no words, no labels and score 0.  Repeated
rows of one doc_id are scanned each and give one row each.  An empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigipanel.llm.bound import bound

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6

BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# label, notice, key phrase within it
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "released under cc0 1 0 universal", "cc0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


def templates() -> list[dict]:
    """Every template with its words and the place of its key phrase; a base phrase is its own key."""
    out = []
    for base, rows in ((True, [(label, p, p) for label, p in BASE]), (False, NOTICES)):
        for label, notice, key in rows:
            words, phrase = notice.split(), key.split()
            at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
            out.append({"label": label, "base": base, "words": words, "key_at": at, "key": phrase})
    return out


def _words(text: Column) -> Column:
    """Lower-cased words; the Kelvin sign must not become an ASCII k, so it is replaced by another letter first."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary; at most one row per word reaches the driver."""
    found = docs.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document with words counted, base phrases and licences located."""
    known = templates()
    tokens = bound(docs, "doc_id", words=_words(F.col("text")))
    vocabulary = sorted({w for t in known for w in t["key"]})
    frequency = document_frequencies(tokens, vocabulary)
    postings: dict[str, list[dict]] = {}
    for t in known:
        rare = min(t["key"], key=lambda w: (frequency.get(w, 0), w))
        postings.setdefault(rare, []).append(t | {"anchor_at": t["key_at"] + t["key"].index(rare)})
    reach = max(len(t["words"]) for t in known)

    def starts(t: dict, held: Column, anchor: str) -> Column:
        """Structs of every place where the key phrase stands, with the share of template words at their places."""
        first = t["anchor_at"]
        at = F.filter(held, lambda h: (h["word"] == anchor) & _key(t, h))
        return F.transform(at, lambda h: F.struct(
            F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"),
            (h["at"] - first + t["key_at"]).cast("long").alias("start"), _share(t, h).alias("share"),
        ))

    def _near(h: Column, offset: int) -> Column:
        return F.get(h["near"], F.lit(reach + offset))

    def _key(t: dict, h: Column) -> Column:
        held = F.lit(True)
        for k, w in enumerate(t["key"]):
            held = held & _near(h, t["key_at"] + k - t["anchor_at"]).eqNullSafe(F.lit(w))
        return held

    def _share(t: dict, h: Column) -> Column:
        same = sum(F.when(_near(h, k - t["anchor_at"]).eqNullSafe(F.lit(w)), 1).otherwise(0) for k, w in enumerate(t["words"]))
        return same / F.lit(float(len(t["words"])))

    hits = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(sorted(postings)), i)), lambda i: i.isNotNull(),
    )
    placed = bound(tokens, "doc_id", "words", places=hits)
    located = bound(placed, "doc_id", n_words=F.size("words").cast("long"), hits=F.transform("places", lambda i: F.struct(
        i.alias("at"), F.get("words", i).alias("word"),
        F.transform(F.sequence(i - reach, i + reach), lambda j: F.when(j >= 0, F.get("words", j))).alias("near"),
    )))
    found = bound(located, "doc_id", "n_words", found=F.when(
        F.size("hits") > 0, F.concat(*[starts(t, F.col("hits"), a) for a, ts in sorted(postings.items()) for t in ts]),
    ).otherwise(F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")))
    base = F.filter("found", lambda x: x["base"])
    accepted = F.filter("found", lambda x: x["base"] | (x["share"] >= LEAST_SHARE))

    def joined(rows):
        return F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(rows, lambda x: x["label"]))))

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(accepted).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform(accepted, lambda x: x["share"])), F.lit(0.0)), 6).alias("score"),
    )
