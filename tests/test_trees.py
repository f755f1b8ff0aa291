from tracelore.functions import trees

O, S = ("Construct", "O", []), ("Construct", "S", [])
ONE = ("App", None, [("AppFun", S), ("AppArg", O)])
GOAL = ("App", None, [("AppFun", ("Ind", "eq", [])), ("AppArg", ("Ind", "nat", [])), ("AppArg", ONE), ("AppArg", ONE)])


def test_golden_of_one_equals_one():
    assert trees.simple_features(GOAL) == ["O", "O-S", "S", "S-eq", "eq", "nat", "nat-eq"]
    found = {(k, t): n for k, t, n in trees.complex_features(GOAL)}
    assert {t: n for (k, t), n in found.items() if k == "Seman"} == {"eq": 1, "nat": 1, "nat-eq": 1, "S": 2, "S-eq": 2, "O": 2, "O-S": 2}
    assert {t: n for (k, t), n in found.items() if k == "Verti"} == {"Root-AppArg-S:AppFun": 2, "Root-AppArg-O:AppArg": 2}
    assert ("Struct", "(-App-X-3-X-(-App-X-1-X-)-(-App-X-1-X-)-)") in found


def test_context_starts_afresh_under_binders_and_goes_on_after_projections():
    fun = ("Lambda", None, [("LambdaType", ("Ind", "T", [])), ("LambdaBody", ("Rel", None, []))])
    whole = ("App", None, [("AppFun", ("Const", "f", [])), ("AppArg", fun), ("AppArg", ("Var", "x", []))])
    assert trees.simple_features(whole) == ["$x", "$x-f", "R", "T", "f"]
    assert trees.simple_features(("Proj", "p", [("ProjTerm", ("Var", "x", []))])) == ["$x", "$x-p", "p"]
    cast = ("App", None, [("AppFun", ("Const", "f", [])), ("AppArg", ("Cast", None, [("CastTerm", ("Int", "3", [])), ("CastType", ("Ind", "T", []))]))])
    assert trees.simple_features(cast) == ["T", "f", "i3", "i3-f"]


def test_silent_kinds_and_deep_cut():
    assert trees.simple_features(("Sort", None, [])) == []
    deep = ("Const", "d", [])
    for _ in range(5):
        deep = ("App", None, [("AppFun", ("Const", "f", [])), ("AppArg", deep)])
    shape = trees.complex_features(deep)[-1][1]
    assert shape.count("(") == 5 and shape.count("X") == 4


def test_size_sexpr_and_preorder():
    assert trees.size(GOAL) == 2 * 9 - 1
    assert trees.sexpr(ONE) == "(App (Construct S) (Construct O))"
    rows = list(trees.nodes(GOAL))
    assert [r[0] for r in rows] == list(range(9)) and rows[0][1] is None and rows[3][4] == "App"


def test_html():
    t = trees.from_html('<div><p>a<br>b</p><a href="/x">l</a></div><!-- <p> --><script>"<i>"</script></ul>')
    assert trees.sexpr(t) == "(App (Const page) (App (Const div) (App (Const p) (Const br)) (App (Const a) (Var /x))))"
    assert trees.from_html(None) == trees.from_html("") == ("Const", "page", [])
    trees.size(trees.from_html("<div>" * 5000))


def test_pages_of_any_depth():
    n = 3000
    t = trees.from_html("<div>" * n + "<b>x</b></div><i>y</i>" + "</div>" * (n - 1) + "<u>z</u>")
    assert [role for role, _ in t[2]] == ["AppFun", "AppArg", "AppArg"] and t[2][2][1] == ("Const", "u", [])
    assert trees.size(t) == 2 * (2 * (n + 1) + 3) - 1
    assert trees.sexpr(t).endswith("(Const i))" + ")" * (n - 2) + " (Const u))")
    found = {k for kind, k, _ in trees.complex_features(trees.from_html("<div>" * 300 + "<b>")) if kind == "Verti"}
    assert "-".join(["Root", *["AppArg"] * 300, "b:AppArg"]) in found
    assert len(trees.scopes(t)) == 2 * (n + 1) + 3


def test_pages_leave_in_small_batches(spark, tmp_path):
    """Rows of many pages never stand in one batch, nor does a page that makes more rows than one holds."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracelore.sources import adapters as ad

    (tmp_path / "pages.parquet").mkdir()
    pages = ["<div>" + "<p class='a'>x</p>" * n + "</div>" for n in (0, 3, 40)] + [None, ""]
    pq.write_table(pa.table({"page_id": pa.array(range(5), pa.int64()), "html": pages}), tmp_path / "pages.parquet" / "0.parquet")
    small = ad.of_pages(spark, str(tmp_path), lambda t: [(sum(1 for _ in ad.trees.nodes(t)), i) for i in range(30)], ad.SCOPES, most=7)
    sizes = small.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"]) for b in batches), "n long")
    assert small.count() == 150 and small.distinct().count() == 150
    assert sizes.agg({"n": "sum"}).first()[0] == 150
    batches = list(ad.page_nodes(spark, str(tmp_path)).groupBy("tree_id").count().collect())
    assert {r["tree_id"] for r in batches} == set(range(5))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
