"""Personal data: found by form, and terms that reveal it by how they co-occur with it in the corpus."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import STEP, Scratch, gathered, map_column, small_batches, word_hashes, words

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is read whole, as no match can begin inside one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}\"'"
_EDGE_BYTES = _EDGE.encode()
#: Documents that a term shares with an entity from which on their counts are taken as they are.
SUPPORT = 3
#: Below that support, the lower end of Wilson's 95 % interval stands for the share of a term's documents that are the entity's.
DOUBT = 1.96
#: Share of the entity's information that a term may give away.
DISCLOSURE = 0.7
#: Terms whose counts a task gathers before it passes them on.
TERM_BLOCK = 2_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each @ is looked at once, so a long run without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of personal data by form, in order; a null text has none."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def signed(value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def entity(kind: int, value: str) -> int:
    value = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
    return signed(f"{kind}:{value}".encode())


def lower(word: str) -> bytes:
    return b"".join(words(word))


def terms_of(text: str, spans: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of every word of a text, in order; what touches one of the spans is left out."""
    taken: list[list[int]] = []
    for s, _, e in sorted(spans):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, i = [], 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        core = m.group().strip(_EDGE)
        if len(core) >= 3:
            at = a + m.group().index(core)
            out.append((signed(lower(core)), at, at + len(core)))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")]))
LONGS = T.ArrayType(T.LongType())


def listed(spans: Sequence[tuple[int, int, int]]) -> list[dict]:
    return [dict(zip(("start", "kind", "end"), x, strict=True)) for x in spans]


def found(docs: DataFrame, *, text: str, keep: list[str]) -> DataFrame:
    """base (spans by form) of each row, and where there are any the distinct entities, all other terms, and the text itself as body."""

    def setup():
        def work(texts):
            base = [base_spans(t) for t in texts]
            both = list(zip(texts, base, strict=True))
            who = [sorted({entity(k, t[s:e]) for s, k, e in b}) for t, b in both]
            terms = [sorted({x for x, _, _ in terms_of(t, b)}) if b else [] for t, b in both]
            return [[listed(b) for b in base], who, terms, [t if b else None for t, b in both]]

        return work

    return map_column(docs, text, setup, [T.StructField("base", SPAN), T.StructField("who", LONGS), T.StructField("terms", LONGS), T.StructField("body", T.StringType())], keep)


def document_frequency(docs: DataFrame, terms: DataFrame, *, text: str) -> DataFrame:
    """(t, df): in how many documents each of the terms stands, over all documents; a task passes its counts on by TERM_BLOCK terms."""
    small_batches(docs.sparkSession)
    most = TERM_BLOCK

    def summed(parts):
        t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        return t[first], np.add.reduceat(n, first)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                texts = batch.column(0).slice(at, STEP).to_pylist()
                each = [word_hashes(list({w.strip(_EDGE_BYTES) for w in words(t)})) for t in texts]
                t, n = np.unique(np.concatenate(each), return_counts=True)
                if not len(t):
                    continue
                held.append(((t ^ np.uint64(1 << 63)).view(np.int64), n))
                size += len(t)
                if size >= most:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if 2 * size >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["t", "df"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], names=["t", "df"])

    part = docs.select(text).mapInArrow(run, "t long, df long")
    return part.groupBy("t").agg(F.sum("df").alias("df")).join(terms, "t", "left_semi")


def estimated(c: Column, df: Column, support: int) -> Column:
    """c / df from `support` documents on, else the lower end of its Wilson interval."""
    p, z = c / df, DOUBT
    low = (p + z * z / (2 * df) - z * F.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)
    return F.when(c >= support, p).otherwise(low)


def pairs(rows: DataFrame, docs: DataFrame, scratch: Scratch, *, text: str, disclosure: float) -> DataFrame:
    """(uid, e, t, c_e, df, n): each entity with each term of the same document, less the pairs that cannot reach `disclosure`.

    rows: found() of the documents with personal data at least, and uid; docs: all documents, of which n counts the rows.

    Entities of exactly the same documents have the same figures, so one of them stands for all. As c(e, t) is c(e) at
    most, a term's own frequency shows which pairs cannot: those are never made.
    """
    n = float(docs.count())
    known = rows.where(F.size("base") > 0)
    member = known.select("uid", F.explode("who").alias("e"))
    where = member.groupBy("e").agg(F.count(F.lit(1)).alias("c_e"), F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.bit_xor(F.xxhash64("uid")).alias("x"))
    one = where.groupBy("c_e", "lo", "hi", "x").agg(F.min("e").alias("e")).select("e", "c_e")
    terms = known.select("uid", F.explode("terms").alias("t"))
    df = document_frequency(docs, terms.select("t").distinct(), text=text)
    near = terms.join(df, "t").join(member.join(one, "e"), "uid")
    can = F.log2(n / F.col("df")) >= disclosure * F.log2(n / F.col("c_e")) - 1e-9
    return scratch.save(near.where(can).select("uid", "e", "t", "c_e", "df", F.lit(n).alias("n")), "pairs", small=True)


def disclosing(near: DataFrame, *, support: int, disclosure: float) -> DataFrame:
    """(e, t, share) of the pairs that give away at least the share `disclosure`."""
    whole = near.groupBy("e", "t").agg(F.count(F.lit(1)).alias("c"), F.first("c_e").alias("c_e"), F.first("df").alias("df"), F.first("n").alias("n"))
    pmi = F.log2(F.col("n") * estimated(F.col("c"), F.greatest("df", "c"), support) / F.col("c_e"))
    share = F.when(F.col("c_e") < F.col("n"), pmi / F.log2(F.col("n") / F.col("c_e"))).otherwise(F.lit(0.0))
    return whole.select("e", "t", share.alias("share")).where(F.col("share") >= disclosure)


def revealing(rows: DataFrame, docs: DataFrame, scratch: Scratch, *, text: str, support: int, disclosure: float) -> DataFrame:
    """(e, t, share): terms that give away at least the share `disclosure` of an entity's information; e as in pairs().

    With documents as the unit, PMI(e; t) = log2(N p(e | t) / c(e)) and IC(e) = log2(N / c(e)); share is their ratio. p(e | t) is
    c(e, t) / df(t), where c(e, t) counts documents that have both, wherever in them, and df all documents of the corpus that have
    t. With c(e, t) below support, the lower confidence bound of p stands for it, so one document counts, but for less.
    """
    return disclosing(pairs(rows, docs, scratch, text=text, disclosure=disclosure), support=support, disclosure=disclosure)


def marked(rows: DataFrame) -> DataFrame:
    """(uid, extra): every place in body of the terms in marks."""

    def run(batches):
        for batch in batches:
            out = []
            for text, base, marks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                want = set(marks)
                out.append(listed([(a, 4, b) for t, a, b in terms_of(text, [(s["start"], s["kind"], s["end"]) for s in base]) if t in want]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, to_arrow_type(SPAN))], names=["uid", "extra"])

    return rows.select("uid", "body", "base", "marks").mapInArrow(run, T.StructType([T.StructField("uid", T.LongType()), T.StructField("extra", SPAN)]))


def term_spans(rows: DataFrame, docs: DataFrame, scratch: Scratch, *, text: str, support: int, disclosure: float) -> DataFrame:
    """(uid, extra): the revealing terms' places in the documents of rows that have any; rows and docs as in pairs()."""
    near = pairs(rows, docs, scratch, text=text, disclosure=disclosure)
    shown = scratch.save(disclosing(near, support=support, disclosure=disclosure).select("e", "t"), "revealing", small=True)
    marks = near.join(shown, ["e", "t"]).groupBy("uid").agg(F.collect_set("t").alias("marks"))
    return marked(rows.where(F.size("base") > 0).join(marks, "uid"))


def detect(docs: DataFrame, *, text: str = "text", key: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """key, base and all_spans (arrays of start, kind, end in code points, by start and then kind) for each row of docs.

    base holds emails, ip addresses, cards and phones by form; all_spans also holds, at every place in the document, the terms
    that give away at least the share `disclosure` of one of its entities' information by co-occurrence in documents of the whole
    corpus. Null and empty texts have empty arrays. Rows may repeat, and each is counted and returned; null keys pass
    through; other columns are not read, so their names clash with nothing; of terms that reveal alike all are spans; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    read = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("x"))
    rows = scratch.save(found(read, text="x", keep=["k"]).withColumn("uid", F.monotonically_increasing_id()), "rows")
    extra = term_spans(rows, read, scratch, text="x", support=support, disclosure=disclosure)
    out = gathered(rows.select("k", "base", "uid").join(extra, "uid", "left"))
    none = F.array().cast(SPAN)
    return out.select(F.col("k").alias(key), "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("all_spans"))


def named(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def generalised(word: str) -> str:
    """What stands for a revealing term: its kind of word."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def redact(text: str | None, spans: Sequence[dict]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    if not text or not spans:
        return text
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] < done:
            done = max(done, s["end"])
            continue
        out += [text[done : s["start"]], generalised(text[s["start"] : s["end"]]) if s["kind"] == 4 else f"[{KINDS[s['kind']].upper()}]"]
        done = s["end"]
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, *, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with personal data and revealing terms in text replaced by what kind of thing they are; all columns stay, whatever their names.

    Spans are those of detect(). Documents without personal data pass through unshuffled. Each row is changed by its own spans, so keys are not needed; repeated rows
    are changed alike. Null and empty texts stay as they are; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at, last = columns.index(text), len(columns)
    looked = found(renamed, text=f"c{at}", keep=renamed.columns)
    rows = scratch.save(looked.where(F.size("base") > 0).withColumn("uid", F.monotonically_increasing_id()), "rows")
    extra = term_spans(rows, renamed, scratch, text=f"c{at}", support=support, disclosure=disclosure)
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))))
    both = rows.join(extra, "uid", "left").select(*renamed.columns, spans.alias("spans"))
    schema = renamed.schema

    def run(batches):
        for batch in batches:
            texts = [redact(t, x) for t, x in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(last)], names=schema.names)

    return looked.where(F.size("base") == 0).select(*renamed.columns).unionByName(both.mapInArrow(run, schema)).toDF(*columns)
