"""PII: base patterns, and an information-theoretic rule for the terms around them.

The base kinds (email, ip, card, phone) are found by patterns. The values found are the protected
entities. For a term of a document that holds an entity, wherever it stands, the corpus tells how
strongly the term reveals it: PMI(term, entity) = log(N n(t,e) / (n(t) n(e))) over documents, as a share
of the entity's information content log(N / n(e)). A share of 1 means that the term occurs only where
the entity does. Terms at or above ``disclosure``, found with the entity in ``support`` different texts,
are spans of kind ``term`` at all their places in the documents that hold the entity.

All of it is DataFrame code. Positions are found inside the row (gaps and matches of one pattern
alternate, so their running lengths are the positions). An entity that fewer than ``support`` documents
hold has no such term, so the terms of documents, as hashes, meet the other entities only; their counts
are combined in each task before they are shuffled, so an entity of a third of all documents
costs one row per task and term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.llm.common import let
from hexweave.session import fresh_dir

DISCLOSURE = 0.8
SUPPORT = 3
CHUNK = 256

# The base patterns. Possessive runs, and a start that is either the run's own or the end of the last
# match, find the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        def weighed(i: Column) -> Column:
            x = F.substring(d, F.char_length(d) - i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return F.when(i % 2 == 1, twice).otherwise(x)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.char_length(d) - 1), weighed), F.lit(0), lambda a, x: a + x)

    return let(_digits(value), lambda d: F.char_length(d).between(12, 19) & (total(d) % 10 == 0))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda x: x.rlike(BYTE)),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running(steps: Column) -> Column:
    """Running totals of an integer array, in chunks: a sum per element would be quadratic."""
    n_chunks = F.floor((F.size(steps) + (CHUNK - 1)) / CHUNK).cast("int")

    def by_chunk(totals: Column) -> Column:
        before = F.transform(totals, lambda _, c: _sum(F.slice(totals, F.lit(1), c)))

        def place(b: Column) -> Column:
            def at(_: Column, i: Column) -> Column:
                c = F.floor(i / CHUNK).cast("int")
                return F.get(b, c) + _sum(F.slice(steps, c * CHUNK + 1, i - c * CHUNK + 1))

            return F.transform(steps, at)

        return let(before, place)

    totals = F.transform(
        F.sequence(F.lit(0), n_chunks - 1), lambda c: _sum(F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))
    )
    return let(totals, by_chunk)


def found(text: Column, pattern: str, kind: int, check: Callable[[Column], Column]) -> Column:
    """Spans of the matches that pass ``check``."""
    none = F.array().cast(SPAN)

    def spans(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(
                hits, lambda h, i: F.char_length(F.get(gaps, i))
                + F.when(i > 0, F.char_length(F.get(hits, i - 1))).otherwise(F.lit(0)),
            )

            def build(starts: Column) -> Column:
                every = F.transform(
                    hits, lambda h, i: F.struct(
                        F.get(starts, i).alias("start"), F.lit(kind).alias("kind"),
                        (F.get(starts, i) + F.char_length(h)).alias("end"), h.alias("value"),
                    ),
                )
                return F.filter(every, lambda x: check(x["value"])).cast(SPAN)

            return let(let(steps, running), build)

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind. Texts without ``@`` or digits are not searched."""
    text = F.coalesce(text, F.lit(""))
    each = [
        F.when(
            F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone"
            else text.rlike("[0-9]"),
            found(text, pattern, k, CHECKS[kind]),
        ).otherwise(F.array().cast(SPAN))
        for k, (kind, pattern) in enumerate(PATTERNS.items())
    ]
    return F.sort_array(F.concat(*each))


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def hashed_terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.xxhash64(F.lower(x))))


def holders(found_docs: DataFrame, support: int) -> DataFrame:
    """_key, held, own and terms of the documents with entities that ``support`` documents hold, once each.

    ``held`` has the hash and the number of documents of each such entity; ``own`` is 1 for one of the documents
    with the same text, else NULL.
    """
    each = found_docs.select(
        "_key", F.explode(F.array_distinct(F.transform("spans", lambda x: F.xxhash64(entity(x))))).alias("entity")
    ).distinct()
    counts = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    held = each.join(counts, "entity").groupBy("_key").agg(F.collect_list(F.struct("entity", "n_entity")).alias("held"))
    own = found_docs.groupBy(F.xxhash64("_text")).agg(F.min("_key").alias("_key")).select("_key", F.lit(1).alias("own"))
    texts = found_docs.select("_key", "_text").dropDuplicates(["_key"]).join(held, "_key").join(own, "_key", "left")
    return texts.select("_key", "held", "own", hashed_terms(F.col("_text")).alias("terms"))


def revealing_terms(held: DataFrame, docs: DataFrame, n: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(entity, term) hashes at or above the threshold, from the `holders`, all texts and their number."""
    each = held.select(F.explode("held").alias("h"), "own", "terms").select("h.*", "own", F.explode("terms").alias("term"))
    pairs = each.groupBy("entity", "term").agg(
        F.max("n_entity").alias("n_entity"), F.count(F.lit(1)).alias("n_both"), F.count("own").alias("texts")
    ).where(F.col("texts") >= support)
    everywhere = docs.select(F.explode(hashed_terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term")
    ).where(F.col("n_term") >= support)
    scored = pairs.join(everywhere, "term").withColumn("n", n.scalar())
    pmi = F.log(F.col("n") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    content = F.nullif(F.log(F.col("n") / F.col("n_entity")), F.lit(0.0))
    return scored.where(F.round(pmi / content, 9) >= disclosure).select("entity", "term")


def find_private(
    docs: DataFrame, carry: Sequence[str] = ("doc_id",), disclosure: float = DISCLOSURE, support: int = SUPPORT,
) -> DataFrame:
    """``carry`` columns, ``_text`` where a span was found (else NULL) and ``spans`` of every row of ``docs``.

    Spans have start and end in code points (end exclusive), ``kind`` as an index into ``KINDS`` and
    the value; they are sorted by start, then kind. NULL and empty texts have none. Equal rows get equal
    spans and count once as evidence. An empty table gives an empty result. Columns that are
    not carried are ignored, so their names cannot clash.

    The base spans are written once to the shared folder, since later steps read them; a text is
    written only where it holds an entity, unless ``carry`` asks for it.
    """
    out = _spans(docs, carry, disclosure, support)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "_text", "spans")


def _spans(docs: DataFrame, carry: Sequence[str], disclosure: float, support: int) -> DataFrame:
    """``find_private`` with the carried columns as c_0, c_1, ..."""
    carried = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carry)]
    base = docs.select(
        F.xxhash64("doc_id", "text").alias("_key"), *carried, base_spans(F.col("text")).alias("spans"), "text"
    ).withColumn("_text", F.when(F.size("spans") > 0, F.col("text"))).drop("text")
    path = fresh_dir(docs.sparkSession, "private")
    base.write.parquet(f"{path}/spans")
    base = docs.sparkSession.read.schema(base.schema).parquet(f"{path}/spans")

    held = holders(base.where(F.size("spans") > 0), support)
    held.write.parquet(f"{path}/held")
    held = docs.sparkSession.read.schema(held.schema).parquet(f"{path}/held")
    n = base.agg(F.count(F.lit(1)).cast("double").alias("n"))
    revealing_terms(held, docs.select("text"), n, disclosure, support).write.parquet(f"{path}/terms")
    terms = docs.sparkSession.read.schema("entity long, term long").parquet(f"{path}/terms")
    each = held.select("_key", F.explode("held.entity").alias("entity"), "terms")
    each = each.join(terms.select("entity").distinct(), "entity", "left_semi")
    each = each.select("_key", "entity", F.explode("terms").alias("term"))
    revealed = each.join(terms, ["entity", "term"]).groupBy("_key").agg(F.collect_set("term").alias("_terms"))
    added = found(F.col("_text"), TERM, KINDS.index("term"), lambda v: F.array_contains(F.col("_terms"), F.xxhash64(F.lower(v))))
    # The parts of an entity's own text go with it.
    added = F.filter(added, lambda x: ~F.exists("spans", lambda s: (s["start"] <= x["start"]) & (x["end"] <= s["end"])))
    spans = F.when(F.col("_terms").isNotNull(), F.sort_array(F.concat("spans", added))).otherwise(F.col("spans"))
    with_entity = base.where(F.size("spans") > 0).join(revealed, "_key", "left").withColumn("spans", spans)
    return with_entity.select(*base.columns).unionByName(base.where(F.size("spans") == 0))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span generalised to its kind in brackets; overlapping spans give one mark."""
    def with_ends(last: Column) -> Column:
        body = F.transform(spans, lambda s, i: _piece(text, s, F.coalesce(F.get(last, i - 1), F.lit(0))))
        rest = F.substring(text, F.element_at(last, -1) + 1, F.char_length(text))
        return F.concat(F.array_join(body, ""), rest)

    furthest = F.transform(
        spans, lambda _, i: F.array_max(F.transform(F.slice(spans, F.lit(1), i + 1), lambda s: s["end"]))
    )
    return F.when(F.size(spans) > 0, let(furthest, with_ends)).otherwise(text)


def _piece(text: Column, span: Column, before: Column) -> Column:
    """The plain text up to a span and the span's mark; nothing for one that an earlier span overlaps."""
    mark = F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), span["kind"])), F.lit("]"))
    plain = F.substring(text, before + 1, span["start"] - before)
    return F.when(span["start"] >= before, F.concat(plain, mark)).otherwise(F.lit(""))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the spans of ``find_private`` generalised in ``text``; all columns and rows stay."""
    out = _spans(docs, docs.columns, disclosure, support)
    clean = F.when(F.size("spans") > 0, sanitised(F.col("_text"), F.col("spans")))
    return out.select(*[
        (F.coalesce(clean, F.col(f"c_{i}")) if c == "text" else F.col(f"c_{i}")).alias(c)
        for i, c in enumerate(docs.columns)
    ])
