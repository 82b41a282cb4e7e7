"""Personal data and the terms that give it away, by information-theoretic sanitisation.

Base spans (e-mail, IP, card, phone) are the protected entities.  Over all documents it is
counted in how many a term occurs and in how many of these together with each kind of
entity.  A term discloses a kind when its pointwise mutual information with the kind reaches
a share of the kind's own information content (a share of 1 means that the term never
occurs without the kind).  In documents that hold the kind, such terms become spans too:
below ``remove_share`` they are generalised to the kind's name, from there on removed.

A code (16 or more ASCII letters, digits, ``_`` and ``-``, with letters and digits among them, as in
keys and tokens) gives a single document away: in n of N documents it has log2(N / n) of the log2(N)
bits that name one.  From ``code_share`` of them on it is removed, in every document that holds it.

Null texts count as empty.  Every row gives one row; repeated rows and null ids are treated
like others (documents are told apart by id and text together).  An empty table gives no
rows.  Other columns of the table are never read, or kept as they are by ``sanitize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.columns import found_at, let, running
from pagelake.llm.common import kept, text_column

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Possessive forms and look-behinds only keep the scan linear: a run that fails from its
# first character fails from all others, as the same character ends it.  An e-mail may start
# inside a run where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "phone": "+"}
WORD = r"\p{L}++"
CODE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a run of digits passes the Luhn check."""

    def place(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + place(i))
    return total % 10 == 0


def holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def kind_spans(text: Column, rank: int, kind: str) -> Column:
    found = found_at(text, PATTERNS[kind])
    if kind in MARKS:  # texts without the mark need no search
        found = F.when(F.contains(text, F.lit(MARKS[kind])), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))
    spans = F.filter(found, lambda s: holds(kind, s["match"]))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All base spans of a text as (start, kind, end), by start and then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        found.append(kind_spans(text, rank, kind))
    return F.array_sort(F.concat(*found))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, F.least(s["kind"], F.lit(len(KINDS)))), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key (the text's hash), base spans and distinct codes."""
    text = text_column(docs, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("key"), base_spans(F.col("text")).alias("base"), distinct_codes("text").alias("codes")
    )


def distinct_codes(text: str) -> Column:
    mixed = F.filter(F.regexp_extract_all(F.col(text), F.lit(CODE), F.lit(0)), lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
    return F.array_distinct(mixed)


def of_kind(kind: int) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def distinct_terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing_terms(docs: DataFrame, holders: DataFrame, share: float, least_docs: int, text_col: str) -> DataFrame:
    """(term, kind, share) for every term at or above the disclosure threshold.

    First the terms that enough documents with a kind hold, then how many of all documents
    hold these.  Documents are reduced to their distinct terms, and these to counts before
    they are shuffled.  The number of all documents and of those with each kind is one row.
    """
    flags = [(F.size(of_kind(i)) > 0).cast("int").alias(f"k{i}") for i in range(len(KINDS))]
    sums = [F.sum(f"k{i}").alias(f"k{i}") for i in range(len(KINDS))]
    with_kind = holders.select(F.explode(distinct_terms("text")).alias("term"), *flags).groupBy("term").agg(*sums)
    likely = kept(with_kind.where(F.greatest(*[f"k{i}" for i in range(len(KINDS))]) >= least_docs))
    # Counted in each task first: what is shuffled are its distinct terms, whatever becomes of the join.
    every = docs.select(F.explode(distinct_terms(text_col)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = every.join(likely, "term")
    n = docs.count()
    totals = holders.select(*flags).agg(*sums).first()
    candidates = []
    for i in range(len(KINDS)):
        if not n or not totals[f"k{i}"] or totals[f"k{i}"] == n:
            continue  # a kind that no or every document holds has nothing to disclose
        content = -F.log2(F.lit(totals[f"k{i}"] / n))
        information = F.log2(F.col(f"k{i}") / F.col("n")) + content
        candidates.append(F.when(F.col(f"k{i}") >= least_docs, F.struct(F.lit(i).alias("kind"), (information / content).alias("share"))))
    if not candidates:
        return counts.select("term", F.lit(0).alias("kind"), F.lit(0.0).alias("share")).limit(0)
    return (
        counts.select("term", F.explode(F.array(*candidates)).alias("c"))
        .where(F.col("c.share") >= share).select("term", "c.kind", "c.share")
    )


def find(
    docs: DataFrame,
    share: float = 0.8,
    remove_share: float = 0.95,
    least_docs: int = 5,
    code_share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, key (hash of the text), base spans and added term spans of rows that have any.

    Spans are (start, kind, end); an added span's kind is 4 plus the number of the kind that
    the term discloses, plus 4 more where it is to be removed; a code's is 8.  Texts are searched
    once; the rows with base spans or codes are written with their texts, for what follows.
    """
    some = docs.where(F.col(text_col).rlike("[0-9@]"))
    found = kept(with_base(some, id_col, text_col).where((F.size("base") > 0) | (F.size("codes") > 0)))
    holders = found.where(F.size("base") > 0)
    # Written and read again: its size is then known, and Spark broadcasts it only if it is small.
    disclosing = kept(disclosing_terms(docs, holders, share, least_docs, text_col))
    kinds = F.array_distinct(F.transform("base", lambda s: s["kind"]))
    hits = (
        holders.select("doc_id", "key", kinds.alias("kinds"), F.explode(distinct_terms("text")).alias("term"))
        .join(disclosing, "term").where(F.array_contains("kinds", F.col("kind")))
        .groupBy("doc_id", "key", "term").agg(F.max(F.struct("share", "kind")).alias("c"))
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("term", (F.col("c.kind") + len(KINDS) + F.when(F.col("c.share") >= remove_share, len(KINDS)).otherwise(0)).alias("kind"))).alias("hits"))
    )
    least = max(docs.count(), 1) ** (1 - code_share)
    each = found.select("doc_id", "key", F.explode("codes").alias("code"))
    rare = kept(each.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") <= least).select("code"))
    telling = each.join(rare, "code").groupBy("doc_id", "key").agg(F.collect_set("code").alias("codes"))
    a, b, c = found.alias("a"), hits.alias("b"), telling.alias("c")

    def overlaps(s: Column, spans: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def coded(spots: Column) -> Column:
        own = F.filter(spots, lambda s: F.array_contains("c.codes", s["match"]) & ~overlaps(s, F.col("a.base")))
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(2 * len(KINDS)).alias("kind"), s["end"].alias("end")))

    def named(spots: Column, taken: Column) -> Column:
        by_term = F.map_from_entries(F.col("b.hits"))
        inside = lambda s: overlaps(s, taken)
        own = F.transform("b.hits", lambda h: h["term"])
        spotted = let(own, lambda terms: F.filter(spots, lambda s: F.array_contains(terms, F.lower(s["match"])) & ~inside(s)))
        return let(by_term, lambda m: F.transform(spotted, lambda s: F.struct(s["start"].alias("start"), F.element_at(m, F.lower(s["match"])).alias("kind"), s["end"].alias("end"))))

    same = [F.col("a.doc_id").eqNullSafe(F.col(f"{t}.doc_id")) & (F.col("a.key") == F.col(f"{t}.key")) for t in "bc"]
    none = F.array().cast(SPAN)
    codes = F.when(F.col("c.codes").isNotNull(), coded(found_at(F.col("a.text"), CODE))).otherwise(none)

    def with_terms(codes: Column) -> Column:
        terms = F.when(F.col("b.hits").isNotNull(), named(found_at(F.col("a.text"), WORD), F.concat("a.base", codes))).otherwise(none)
        return F.concat(codes, terms)

    return a.join(b, same[0], "left").join(c, same[1], "left").select("a.doc_id", "a.key", "a.base", let(codes, with_terms).alias("added"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text, of every row."""
    found = find(docs, id_col=id_col, text_col=text_col, **options).dropDuplicates(["doc_id", "key"]).alias("f")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_column(docs, text_col)).alias("key")).alias("r")
    none = F.array().cast(SPAN)
    joined = rows.join(found, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")), "left").select(
        "r.doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")
    )
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select(
        "doc_id", *counts,
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced; overlapping spans count as one, named by the first."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS], *[F.lit(f"[{k} context]") for k in KINDS], *[F.lit("")] * len(KINDS))

    def put(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def pieces(e: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), e)
            cut = F.zip_with(
                s,
                F.slice(before, F.lit(1), F.size(s)),
                lambda x, done: F.when(
                    x["start"] >= done,
                    F.concat(F.substr(text, (done + 1).cast("int"), (x["start"] - done).cast("int")), F.get(names, x["kind"])),
                ).otherwise(F.lit("")),
            )
            return F.concat(F.array_join(cut, ""), F.substr(text, (F.element_at(e, -1) + 1).cast("int"), F.length(text)))

        return let(ends, pieces)

    return F.when(F.size(spans) > 0, let(spans, put)).otherwise(text)


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with personal data named by kind, and disclosing terms generalised or removed.

    Columns stay as they are; texts without spans stay too, null ones included.
    """
    spans = find(docs, id_col=id_col, text_col=text_col, **options)
    spans = (
        spans.select(F.col("doc_id").alias("_pii_id"), F.col("key").alias("_pii_key"), F.array_sort(F.concat("base", "added")).alias("_pii_spans"))
        .dropDuplicates(["_pii_id", "_pii_key"])
    )
    key = F.xxhash64(text_column(docs, text_col))
    joined = docs.withColumn("_pii_text", key).join(
        spans, F.col(id_col).eqNullSafe(F.col("_pii_id")) & (F.col("_pii_text") == F.col("_pii_key")), "left"
    )
    new = F.when(F.col("_pii_spans").isNotNull(), replaced(F.col(text_col), F.col("_pii_spans"))).otherwise(F.col(text_col))
    return joined.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
