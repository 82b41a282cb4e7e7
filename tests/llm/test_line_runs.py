"""Line dedup against plain Python, whatever the batches and the fan-out."""

import pytest

from pagelake.llm import line_runs
from pagelake.sources.versions import Versions

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANK).translate(LOW)


def plain(rows, least=10):
    after = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= least and (k not in first or after(i) < after(first[k])):
                first[k] = i
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in line_runs.drop_repeated(df, **how).collect()), key=repr)


LONG = ["a line that repeats", "  A line THAT repeats\t", "Another line here", "ÉLAN vital 漢字 😀 xx", "élan vital 漢字 😀 xx", "short", "", "one two three four"]
ROWS = [
    (5, "\n".join(LONG[:4])), (3, "\n".join(LONG[1:])), (9, "a line that repeats\n\nshort\nsomething of its own"), (1, None), (2, ""), (4, "\n\n"),
    (7, "a line that repeats"), (8, "own line only here\nown line only here"), (6, "\r\na LINE that repeats\r\n a line that repeats"),
    (5, "Another line here\nfresh words of five"), (None, "a line that repeats\nheld by no id at all"), (None, "held by no id at all"), (9, "a line that repeats\n\nshort\nsomething of its own"),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (5, 2), (4, 3), (50, 2)])
def test_rows_equal_plain_python(docs, batches, fanout):
    df = docs([t for _, t in ROWS], ids=[i for i, _ in ROWS])
    assert found(df, batches=batches, fanout=fanout) == plain(ROWS)


def test_odd_texts(docs, odd_texts):
    odd = [*odd_texts, "\n".join(f"line number {i % 50}" for i in range(3000)), "\n".join(f"line number {i % 70}" for i in range(3000))]
    assert found(docs(odd)) == plain(list(enumerate(odd)))
    assert found(docs([])) == [] and found(docs([None, "x"], ids=[None, None])) == plain([(None, None), (None, "x")])


def test_a_line_in_every_document(docs):
    texts = [f"the line that all documents hold\nown line number {i}\nTHE line that all documents hold" for i in range(300)]
    assert found(docs(texts)) == plain(list(enumerate(texts)))


def test_least_is_in_code_points(docs):
    rows = [(1, "漢字漢字漢字漢字漢"), (2, "漢字漢字漢字漢字漢"), (3, "漢字漢字漢字漢字漢字"), (4, "漢字漢字漢字漢字漢字")]
    assert found(docs([t for _, t in rows], ids=[i for i, _ in rows])) == plain(rows)


def test_levels_and_restarts(spark, docs, tmp_path):
    path = str(tmp_path / "runs")
    levels = []
    for k in range(7):
        store = line_runs.LineRuns(spark, path, fanout=2)  # a new session finds the runs of the old one
        gone = store.add(docs([f"first line of batch {k}\nfirst line of batch {k // 2}"], ids=[k]))
        levels.append(sorted(r["level"] for r in store.runs()))
        again = [r["gone"] for r in gone.collect()]
        assert again == ([] if k == 0 else [[1]] if k == 1 else [[1]]), k
    assert levels == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    keys = sum(store._run(r["name"]).count() for r in store.runs())
    assert keys == 7
    store.vacuum()
    assert store.add(docs(["first line of batch 6"], ids=[100])).collect()[0]["gone"] == [0]


def test_a_batch_that_dies_leaves_no_trace(spark, docs, tmp_path, monkeypatch):
    store = line_runs.LineRuns(spark, str(tmp_path / "runs"))
    store.add(docs(["a line that is known"], ids=[1]))
    runs = store.runs()
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            store.add(docs(["a line that was lost"], ids=[2]))
    assert store.runs() == runs
    assert store.add(docs(["a line that was lost\na line that is known"], ids=[3])).collect()[0]["gone"] == [1]


def test_runs_are_not_shuffled(spark, docs, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = line_runs.LineRuns(spark, str(tmp_path / "runs"))
        store.add(docs(["a line that is known"], ids=[1]))
        own = line_runs.line_keys(docs(["x"]), "doc_id", "text", 1).groupBy("h", "g").count()
        plan = own.join(store._run(store.runs()[0]["name"]), ["h", "g"], "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
