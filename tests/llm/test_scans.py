"""Operators that judge each document alone, beside plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pagelake.llm import langid, licenses, packing, pii, quality, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def native():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(native, text):
    return np.array([*native.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_packing(rows, texts, native):
    sequences, total = {}, Counter()
    for r in rows:
        ids = ids_of(native, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == {i: len(ids_of(native, t)) for i, t in texts.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_takes_every_id_once_without_padding(docs, odd_texts, native):
    odd_texts = [*odd_texts, "a<|endoftext|>B <|EndOfText|>", "x\x0by\x0cz\x1cq\x85r s", "é ́", "ΣΑΣ İ I'LL don't"]
    df = docs(odd_texts)
    check_packing(packing.pack(df, WORDS).collect(), dict(enumerate(odd_texts)), native)
    assert packing.pack(df.limit(0), WORDS).collect() == []
    twice = packing.pack(df.union(df).select("doc_id", "text"), WORDS).collect()
    assert sum(r["length"] for r in twice) == 2 * sum(len(ids_of(native, t)) for t in odd_texts)


def test_words_before_punctuation_and_in_capitals_take_the_short_way(native):
    """Only what the library would change or split otherwise goes through all its steps, and ids are the library's."""
    plain = ["hello&&&", "hello!!", "Élan%%%", "Rajañ", "ÉLAN.", "x'", "\u01c5"]
    others = ["it's", "ΣΑΣ!", "İx.", "a<|endoftext|>", "H\u0331", "e\u0301!", "a1", "é\u0338", "!\u0338"]
    tokens = packing.Tokenizer(WORDS)
    assert [p for p in plain + others if tokens.word_of(p) is None] == others
    parts = packing.lowered([*plain, *others, "HELLO&&&", "A<|endoftext|>B", "", "..."])
    for part, ids in zip(parts, tokens.ids_of(parts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == native.encode(part, add_special_tokens=False).ids
    assert parts[-4:] == ["hello&&&", "A<|endoftext|>B", "", "..."]


@pytest.mark.parametrize("seed", range(4))
def test_bin_slack_finds_the_best_sum(seed):
    r = np.random.default_rng(seed)
    counts = Counter(r.integers(1, 40, 12).tolist())
    chosen, times = packing.bin_slack(counts, 64)
    used, first = Counter(chosen), max(counts)
    assert used[first] >= 1 and all(n * times <= counts[x] for x, n in used.items()) and times >= 1
    sums = {first}
    rest = counts - Counter([first])
    for x in rest.elements():
        sums |= {s + x for s in sums}
    assert sum(chosen) == max(s for s in sums if s <= 64)


def test_quality_learns_and_scores_every_row(spark, docs, odd_texts):
    good = [f"the plain words of text {i} and more of it" for i in range(60)]
    bad = [f"the### plain&&& words%%% of*** text {i}$$$ and###" for i in range(60)]
    df = docs(good + bad + odd_texts)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality_scores(df, labels).collect()}
    assert len(rows) == 120 + len(odd_texts)
    for i, r in rows.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [r["predicted"] == int(i < 60) for i, r in rows.items() if i < 120 and r["held_out"]]
    assert held and all(held)
    none = quality.quality_scores(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_dual_descent_reaches_the_hinge_optimum():
    r = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([r.integers(0, 20, 4) + 20 * (i % 2), r.integers(40, 60, 4)])) for i in range(80)]
    y = np.array([i % 2 for i in range(80)])
    weight, bias = quality.fit_support_vectors(rows, y, 64)
    assert all((weight[x].sum() + bias > 0) == bool(t) for x, t in zip(rows, y, strict=True))


def test_language_backs_off_to_shorter_grams(docs, odd_texts):
    texts = ["der hund und die katze schlafen", "the dog and the cat sleep", "el perro y el gato duermen"] * 8 + odd_texts
    df = docs(texts, langs=["de", "en", "es"] * 8 + [None] * len(odd_texts))
    rows = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if i < 24:
            assert rows[i]["lang_pred"] == ("de", "en", "es")[i % 3]
        if not re.search(r"[^\W\d_]", t or ""):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
        assert 0 <= rows[i]["score"] <= 1
    tables = {0: {"dog": np.array([1.0])}, 4: {"<cat": np.array([2.0])}, 3: {"log": np.array([3.0])}, 2: {}, 1: {"z": np.array([4.0])}}
    assert [float(langid.vote(w, tables)[0]) for w in ("dog", "cats", "log", "z")] == [1, 2, 3, 4]
    assert langid.vote("qq", tables) is None
    empty = langid.identify(df.limit(0))
    assert empty.collect() == []
    assert {r["lang_pred"] for r in langid.identify(df.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def best_count(word, pieces):
    at = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(at[end - 1][0] + token_counts.UNCOVERED, at[end - 1][1] - 1)]
        options += [(at[s][0] + pieces[word[s:end]], at[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        at[end] = max(options)
    return -at[len(word)][1]


def test_token_counts_match_unshared_scores(docs, odd_texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.pieces_of(path)
    texts = [*odd_texts[:6], odd_texts[6][:4000], "unbelievable unbelievably unbeliever"]
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs(texts), path).collect()}
    for i, t in enumerate(texts):
        parts = [p.decode() for p in (t or "").encode().split()]
        assert (rows[i]["n_pretokens"], rows[i]["n_tokens"]) == (len(parts), sum(best_count("▁" + p, pieces) for p in parts))
    assert token_counts.count_tokens(docs(texts).limit(0), path).collect() == []
    trie = token_counts.Trie(pieces)
    for w in ("unbelievable", "unbelievably", "unbeliever"):
        trie.insert(w)
    assert trie.scored == len("unbelievable") + len("y") + len("er")


def plain_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD_DATA = [
    "a@b.c_d@e.f and x@y@z.org, é.ü@a.b 😀 me.you+1@x-y.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 000255.01.1.1 1.2.3", "4111 1111 1111 1111 and 4111111111111112, 41-11111111111111",
    "+49 (30) 123-4567 and +1  +2 3 4 5 6 7 8 9+", "1" * 20000, "a" * 20000 + "@", "a.b-" * 5000 + "@x." + "y." * 4000 + "z",
]


def test_base_spans_match_plain_expressions(docs, odd_texts):
    texts = odd_texts + ODD_DATA
    rows = {r["doc_id"]: r for r in pii.report(docs(texts)).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert rows[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert rows[i]["spans"] == text
    assert pii.report(docs(texts).limit(0)).collect() == []


def test_terms_that_disclose_are_generalised_or_removed(docs):
    texts = [f"reach zorbo{'' if i % 2 else ' quux'} at me{i}@x.org now" for i in range(10)] + [f"reach at quiet place {i} now" for i in range(30)]
    texts += ["quux alone", "zorbo without it", None]
    df = docs(texts)
    rows = {r["doc_id"]: r["spans"] for r in pii.report(df, least_docs=5).collect()}
    assert rows[0] == "term:6:11,term:12:16,email:20:29"
    assert rows[1] == "term:6:11,email:15:24"
    assert rows[11] == rows[40] == rows[41] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(df, least_docs=5).collect()}
    assert clean[1] == "reach [email context] at [email] now"
    assert clean[41] == texts[41] and clean[42] is None
    assert pii.sanitize(df).columns == df.columns


def test_license_phrases_and_templates(docs, odd_texts):
    notice = licenses.TEMPLATES["bsd"].upper().replace(" ", ", ")
    most = " ".join(licenses.TEMPLATES["gpl"].split()[:-3])
    texts = [*odd_texts, "Under the MIT License! under the mit\nlicense", "Apache License, Version 2.0; CC BY-NC 4.0", f"x\n\n{notice}\n \ny", most, "this is licensed", "under the mit licensee"]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(texts)).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (rows[i]["n_words"], rows[i]["n_base"]) == (len(w), len(at))
        assert rows[i]["first_word"] == min((k for k, _ in at), default=None)
        assert rows[i]["last_word"] == max((k for k, _ in at), default=None)
        assert rows[i]["base_labels"] == ",".join(sorted({x for _, x in at}))
        met = set()
        for block in re.split(r"\n[ \t\r]*\n\s*", low):
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", block))
            met |= {x for x, t2 in licenses.TEMPLATES.items() if len(own & set(t2.split())) >= 0.8 * len(set(t2.split())) - 1e-9}
        assert rows[i]["labels"] == ",".join(sorted(met | {x for _, x in at}))
    assert "bsd" in rows[12]["labels"] and "gpl" in rows[13]["labels"]
    assert licenses.scan(docs(texts).limit(0)).collect() == []
