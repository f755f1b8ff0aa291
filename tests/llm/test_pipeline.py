import corpus_pipeline as cp
from tracelore.llm import decontaminate, near_dup, sanitise

D = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sizes = [docs.count()]
    at = docs
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, at, D)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(at.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    kept = spark.read.parquet(f"{tmp_path}/3")
    assert near_dup.classes(spark.read.parquet(f"{tmp_path}/1")).where("not kept").count() == 0
    assert decontaminate.contaminated(spark.read.parquet(f"{tmp_path}/2"), spark.read.parquet(f"{D}/benchmark.parquet")).count() == 0
    assert sanitise.detect(kept).where("size(base) > 0").count() == 0
    assert {r[0] for r in at.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    assert sorted(map(tuple, cp.run(spark, D).collect())) == sorted(map(tuple, at.collect()))


def test_empty_documents(spark):
    at = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        at = stage(spark, at, D)
    assert at.count() == 0


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, against plain code: a scan for terms, all pairs of shingle sets, tiling of every item, counting of terms."""
    import re

    import numpy as np
    from test_sanitise import brute_terms
    from test_toxicity import plain

    from tracelore.llm import toxicity

    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 120")
    at = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(cp.STAGES)
    keep = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    lexicon = toxicity.learn(docs, spark.read.parquet(f"{D}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, D)
    want = {i: t for i, t in at.items() if toxicity.normalised(plain(lexicon, t)[0], len(t or "")) < lexicon.threshold}
    assert keep(clean) == want

    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if (w := words(t)) else set() for i, t in want.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = {i: t for i, t in want.items() if top(i) == i}
    single = stages["near_dedup"](spark, clean, D)
    assert keep(single) == want

    items = [decontaminate.word_hashes(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]

    def leaks(t):
        tokens = decontaminate.word_hashes(decontaminate.words(t))
        return any(len(p) and np.isin(p, tokens).mean() >= 0.6 and sum(g[2] for g in decontaminate.tiles(p, tokens, min(3, len(p)))) >= 0.6 * len(p) for p in items)

    want = {i: t for i, t in want.items() if not leaks(t)}
    free = stages["decontamination"](spark, single, D)
    assert keep(free) == want

    ids = sorted(want)
    named = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in brute_terms([want[i] for i in ids])]
    want = {i: sanitise.redact(want[i], s) for i, s in zip(ids, named)}
    private = stages["pii"](spark, free, D)
    assert keep(private) == want

    lengths = {}
    for r in stages["packing"](spark, private, D).collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(words(t)) for i, t in want.items()}
