"""Language identification against a plain re-implementation, and its odd cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import regex

from pagelake.llm import langid

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    words = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    counts = {}
    for i, text, lang in rows:
        if lang is None or text is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for w in words(text):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in langid.ORDERS:
                for g in langid.grams(w, n):
                    counts.setdefault((lang, n), Counter())[g] += 1
    langs = sorted({r[2] for r in rows if r[2] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5})
    total = {k: sum(c.values()) for k, c in counts.items()}
    known = {n: set().union(*[counts.get((g, n), ()) for g in langs]) for n in (0, *langid.ORDERS)}
    log = lambda g, n, t: math.log((counts.get((g, n), Counter())[t] + 0.5) / (total.get((g, n), 0) + 1.0))

    def vote(w):
        if w in known[0]:
            return [log(g, 0, w) for g in langs]
        for n in langid.ORDERS:
            some = [x for x in langid.grams(w, n) if x in known[n]]
            if some:
                return [sum(log(g, n, x) for x in some) / len(some) for g in langs]
        return [0.0] * len(langs)

    out = {}
    for i, text, _ in rows:
        ws = words(text)
        if not ws or not langs:
            out[i] = ("und", 0.0)
            continue
        votes = np.array([vote(w) for w in ws]).mean(0)
        share = np.exp(votes - votes.max())
        out[i] = (langs[int(share.argmax())], share.max() / share.sum())
    return out


def test_predictions_equal_a_plain_model(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(900, "\u00bd \u00b2 12", "en"), (901, "\u2167 \u2460", "de"), (902, "\u00bdzwei\u00b2drei", None), (903, None, "fr"), (904, "", "fr")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, w long")
    want = plain(rows)
    for r in langid.identify(df).collect():
        name, share = want[r["doc_id"]]
        assert r["lang_pred"] == name and abs(r["score"] - share) < 1e-3, r["doc_id"]
    assert want[900][0] == want[901][0] == "und" and want[902][0] != "und"


def test_small_languages_keep_all_their_words(spark):
    rare = [(i, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + i)}" for k in range(400)), "rare") for i in range(6)]
    rows = rare + [(100 + i, f"common text {'abcdefghij'[i % 10]} number", "big") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    table = langid.Table(0, *model["tables"][0])
    assert all(table.get(w) is not None for _, t, _ in rows for w in re.findall(r"[a-z]+", t))


def test_rows_of_one_id_are_learned_each_with_its_language(spark):
    rows = [(7, "uno dos tres", "es"), (7, "one two three", "en"), (7, "one two three", "en"), (None, "eins zwei drei", "de")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    table = langid.Table(0, *model["tables"][0])
    assert model["langs"] == ["de", "en", "es"]
    for word, at in (("uno", 2), ("two", 1), ("drei", 0)):
        assert int(table.get(word).argmax()) == at
    assert abs(float(table.get("one")[1]) - math.log(1.5 / 4.0)) < 1e-5
