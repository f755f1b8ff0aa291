import random
import re

from pyspark.sql import functions as F

from tracelore.llm import sanitise as sn


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (r, ok) in enumerate(rules) for m in re.finditer(r, text or "") if ok(m.group()))


def test_forms_against_plain_patterns():
    r = random.Random(2)
    pieces = ["a.b@c.de", "@", "x@y", "u@v.w.z", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "12345678901234", "+1 (377) 555-0271", "+123", "+49.30.1234567", " ", "-", "é", "9", "\n", "%", "007.1.2.3", "a@b..c", "a@b.c@d.e", "0000000000000000"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))
        assert sn.base_spans(t) == brute(t), t
    assert sn.base_spans(None) == sn.base_spans("") == []
    assert sn.base_spans("a" * 200_000) == []
    assert len(sn.base_spans("1" * 50_000 + " a@b.cd")) == 1


def frame(spark):
    told = [(i, f"Our friend Zanzibarov, reach me at zb@secret.org today {i}") for i in range(4)]
    filler = [(100 + i, f"today our friend and me at number {i}") for i in range(40)]
    rest = [(200, None), (201, ""), (202, "call +1 (377) 555-0271 or 1.2.3.4"), (None, "zz@top.org"), (203, "plain"), (203, "plain")]
    return spark.createDataFrame([(*r, 1) for r in [*told, *filler, *rest]], "doc_id long, text string, base int")


def test_terms_that_reveal_are_spans(spark):
    out = sn.detect(frame(spark)).withColumn("said", sn.named("all_spans")).collect()
    assert len(out) == 50
    by = {r["doc_id"]: r for r in out}
    for i in range(4):
        text = f"Our friend Zanzibarov, reach me at zb@secret.org today {i}"
        terms = [text[s["start"] : s["end"]] for s in by[i]["all_spans"] if s["kind"] == 4]
        assert "Zanzibarov" in terms and "friend" not in terms and "today" not in terms
        assert by[i]["said"].startswith("term:11:21")
    assert by[200]["all_spans"] == by[201]["all_spans"] == []
    assert [s["kind"] for s in by[202]["all_spans"]] == [3, 1] and len(by[None]["all_spans"]) == 1
    assert sn.detect(frame(spark).limit(0)).count() == 0


def test_share_is_pmi_over_information(spark):
    from tracelore.llm.common import Scratch

    docs = frame(spark)
    scratch = Scratch(spark, "t")
    rows = scratch.save(sn.found(docs, text="text", keep=["doc_id"]).withColumn("uid", F.monotonically_increasing_id()), "rows")
    got = {r["t"]: r["share"] for r in sn.revealing(rows, docs, scratch, text="text", support=3, disclosure=-9.0).collect()}
    from math import log2

    df = sum("friend" in (r["text"] or "").split() for r in docs.collect())
    assert abs(got[sn.signed(b"friend")] - log2(50 * 4 / (4 * df)) / log2(50 / 4)) < 1e-9
    assert abs(got[sn.signed(b"zanzibarov")] - 1) < 1e-9


def rare(spark):
    """One entity in one document, among 1,000 others; every word but two stands in many documents."""
    told = [(0, "our friend Zanzibarov can be reached at zb@secret.org today")]
    filler = [(i, f"today our friend and others can be reached at number {i}") for i in range(1, 1001)]
    return spark.createDataFrame([*told, *filler], "doc_id long, text string")


def test_terms_of_an_entity_in_one_document(spark):
    text = "our friend Zanzibarov can be reached at zb@secret.org today"
    by = {r["doc_id"]: r["all_spans"] for r in sn.detect(rare(spark)).collect()}
    assert [text[s["start"] : s["end"]] for s in by[0] if s["kind"] == 4] == ["Zanzibarov"]
    assert not any(s for i, s in by.items() if i)


def test_terms_far_from_the_entity_and_again(spark):
    text = "Zanzibarov, our friend, " + "today our friend and others can be reached at number " * 3 + "zb@secret.org or as (zanzibarov)."
    filler = [(i, f"today our friend and others can be reached at number {i}") for i in range(1, 1001)]
    docs = spark.createDataFrame([(0, text), *filler], "doc_id long, text string")
    by = {r["doc_id"]: r["all_spans"] for r in sn.detect(docs).collect()}
    assert [text[s["start"] : s["end"]] for s in by[0] if s["kind"] == 4] == ["Zanzibarov", "zanzibarov"]


def test_few_documents_count_for_less(spark):
    got = spark.createDataFrame([(1, 1), (2, 4), (3, 6), (0, 5)], "c long, df long").select(sn.estimated(F.col("c"), F.col("df"), 3)).collect()
    assert [round(r[0], 4) for r in got] == [0.2065, 0.15, 0.5, 0.0]


def test_terms_in_blocks_count_alike(spark, monkeypatch):
    docs = frame(spark)
    terms = spark.createDataFrame([(sn.signed(w),) for w in (b"friend", b"today", b"zanzibarov", b"nowhere")], "t long")
    one = sorted(map(tuple, sn.document_frequency(docs, terms, text="text").collect()))
    monkeypatch.setattr(sn, "TERM_BLOCK", 1)
    assert sorted(map(tuple, sn.document_frequency(docs, terms, text="text").collect())) == one and len(one) == 3


def test_sanitised_text(spark):
    docs = frame(spark)
    out = sn.sanitise(docs)
    assert out.columns == docs.columns and out.count() == 50
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[2].startswith("Our friend [NAME], ") and "[EMAIL] today" in by[2] and "zb@" not in by[2]
    assert by[202] == "call [PHONE] or [IP]" and by[200] is None and by[201] == "" and by[None] == "[EMAIL]"


def brute_terms(texts, support=sn.SUPPORT, disclosure=sn.DISCLOSURE):
    """Spans of each text with counts in plain dictionaries; documents are numbered, repeated ones count each."""
    from math import log2, sqrt

    trim = ".,;:!?()[]{}\"'"
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    base = [brute(t) for t in texts]
    value = lambda k, v: (k, v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v))
    who = [{value(k, t[a:b]) for a, k, b in s} for t, s in zip(texts, base)]
    df, of_entity = {}, {}
    for d, t in enumerate(texts):
        for w in {w.strip(trim) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))}:
            df[w] = df.get(w, 0) + 1
        for e in who[d]:
            of_entity.setdefault(e, set()).add(d)
    terms = []
    for t, s in zip(texts, base):
        found = [(m.start() + m.group().index(core), core) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if len(core := m.group().strip(trim)) >= 3 and not any(a < m.end() and m.start() < b for a, _, b in s)]
        terms.append([(at, at + len(core), core.translate(lower)) for at, core in found] if s else [])
    having = {}
    for d, x in enumerate(terms):
        for w in {w for _, _, w in x}:
            having.setdefault(w, set()).add(d)
    n, out = len(texts), []
    for d, (s, x) in enumerate(zip(base, terms)):
        shown = set()
        for w in {w for _, _, w in x}:
            for e in who[d]:
                c, c_e = len(of_entity[e] & having[w]), len(of_entity[e])
                m, z = max(df[w], c), sn.DOUBT
                p = c / m if c >= support else (c / m + z * z / (2 * m) - z * sqrt(c / m * (1 - c / m) / m + z * z / (4 * m * m))) / (1 + z * z / m)
                if c_e < n and log2(n * p / c_e) / log2(n / c_e) >= disclosure:
                    shown.add(w)
        out.append(sorted([*s, *((a, 4, b) for a, b, w in x if w in shown)]))
    return out


def test_all_spans_against_plain_counts(spark):
    """The whole of a table, texts whole: the operator's spans are those that plain counting gives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame(spark).selectExpr("coalesce(doc_id, 0) + 1000000 as doc_id", "text")).unionByName(docs.where("doc_id % 9 = 0").selectExpr("doc_id + 2000000 as doc_id", "text"))
    rows = sorted(map(tuple, docs.collect()), key=lambda r: r[0])
    got = {}
    for r in sn.detect(docs).collect():
        got.setdefault(r["doc_id"], []).append([(s["start"], s["kind"], s["end"]) for s in r["all_spans"]])
    want = {}
    for (i, _), s in zip(rows, brute_terms([t for _, t in rows])):
        want.setdefault(i, []).append(s)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert sum(k == 4 for x in want.values() for s in x for _, k, _ in s) > 50


def test_very_many_entities_and_columns_of_any_name(spark):
    text = " ".join(f"user{i}@mail{i}.example.org said word{i % 7}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, "calm words", 1, 2, 3, 4)], "doc_id long, text string, __k int, Base int, uid int, WHO int")
    out = sn.sanitise(docs)
    assert out.columns == docs.columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["text"].count("[EMAIL]") == 60_000 and by[2]["text"] == "calm words" and by[1]["WHO"] == 4
    assert sn.detect(docs).where("size(base) = 60000").count() == 1


def test_redact_overlaps():
    s = lambda a, k, b: {"start": a, "kind": k, "end": b}
    assert sn.redact("0123456789", [s(2, 1, 6), s(4, 2, 8), s(9, 4, 10)]) == "01[IP]8[NUMBER]"
    assert sn.redact("abc", []) == "abc"
