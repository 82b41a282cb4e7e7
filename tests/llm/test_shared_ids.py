"""Rows that share an id but hold different texts are one node, and no link of theirs is lost."""

import pytest

from pagelake.llm import shingle_join


def words(prefix, n=60):
    return [f"{prefix}{i}" for i in range(n)]


A, B, C = (" ".join(words(p)) for p in "abc")


def near(text):
    return " ".join([*text.split(), "more"])


def found(df):
    return {(r["doc_id"], r["component_id"]) for r in shingle_join.near_duplicates(df).collect()}


@pytest.mark.parametrize("copied", [A, B])
def test_both_texts_of_an_id_are_compared(docs, copied):
    # One of the two has the larger digest.
    df = docs([A, B, near(copied)], ids=[4, 4, 5])
    assert found(df) == {(4, 4), (5, 4)}
    assert [r["doc_id"] for r in shingle_join.one_of_each(df).collect()] == [4, 4]


def test_three_texts_of_an_id_are_chained(docs):
    df = docs([A, B, C, near(A), near(B), near(C), near(C)], ids=[4, 4, 4, 5, 1, 6, 7])
    assert found(df) == {(i, 1) for i in (1, 4, 5, 6, 7)}
    df = docs([A, B, C, near(A), near(B), near(C)], ids=[9, 9, 9, 1, 2, 3])
    assert found(df) == {(i, 1) for i in (1, 2, 3, 9)}
