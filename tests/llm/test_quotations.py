from fleetlens.llm import quotations


def threads(spark, rows, scope="list"):
    df = spark.createDataFrame(rows, "list string, at long, body string")
    return {(r.scope, r.position): r for r in quotations.conversations(df, scope, "at", "body").collect()}


def test_nested_quotes_and_announcements(spark):
    got = threads(spark, [
        ("l", 1, "Shall we meet?\nOn Monday?"),
        ("l", 2, "On 1 May Ann wrote:\n> Shall we meet?\n> On Monday?\n\nYes, gladly."),
        ("l", 3, "On 2 May Bob wrote:\n> On 1 May Ann wrote:\n>> Shall we meet?\n>> On Monday?\n> Yes, gladly.\n\nFine then."),
        ("l", 4, "> > Shall we  MEET? On Monday?\nNo, never."),  # other marks, spaces and case, the parent itself not quoted
        ("l", 5, "> Yes, gladly.\nOh dear.\n> Fine then.\nGood."),  # answers two: the one quoted more
        ("l", 6, "> nobody said this\nHm."),
        ("m", 2, "> Shall we meet?\nWrong list."),
    ])
    parent = {k: r.parent for k, r in got.items()}
    assert parent == {("l", 1): None, ("l", 2): 1, ("l", 3): 2, ("l", 4): 1, ("l", 5): 2, ("l", 6): None, ("m", 2): None}
    assert got["l", 3].text == "Fine then." and got["l", 5].text == "Oh dear.\nGood." and got["l", 1].text == "Shall we meet?\nOn Monday?"
    assert {k[1]: (r.root, r.depth) for k, r in got.items() if k[0] == "l"} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 1), 5: (1, 2), 6: (6, 0)}
    # parents before replies, numbers without a gap
    order = sorted((r.place, k[1]) for k, r in got.items() if k[0] == "l" and r.root == 1)
    assert order == [(0, 1), (1, 2), (2, 4), (3, 3), (4, 5)]


def test_a_long_chain_and_a_star(spark):
    chain = [("c", 0, "message 0 here")] + [("c", k, f"> message {k - 1} here\nmessage {k} here") for k in range(1, 130)]
    star = [("s", 0, "the first one")] + [("s", k, f"> the first one\nanswer {k}") for k in range(1, 700)]
    got = threads(spark, chain + star)
    assert all(got["c", k].depth == k and got["c", k].root == 0 and got["c", k].place == k for k in range(130))
    assert all(got["s", k].depth == 1 and got["s", k].place == k for k in range(1, 700))


def test_defined_cases(spark):
    got = threads(spark, [
        (None, 1, "same words"), (None, 2, "same words"), (None, 3, "> same words\nreply"), (None, 3, "> same words\nreply"), ("e", 1, None), ("e", 2, ""),
        ("e", 3, "> \n>\n"), ("e", None, "no position"), ("e", 9, "> no position\nx"), ("e", 10, "> later words\ny"), ("e", 11, "later words"),
    ])
    assert got[None, 3].parent == 1 and got[None, 2].parent is None  # the earliest of equal originals
    assert got["e", 9].parent is None and got["e", 9].parent_copy == got["e", None].copy and got["e", 9].depth == 1
    assert got["e", 10].parent_copy is None and got["e", 1].text == "" and got["e", 3].text == "" and got[None, 3].n_rows == 2
    assert len(got) == 10
    assert threads(spark, []) == {}


def test_without_a_scope_everything_is_one(spark):
    assert threads(spark, [("a", 1, "hello there"), ("b", 2, "> hello there\nhi")], scope=None)[None, 2].parent == 1


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "bot", "c"), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    mails = quotations.as_mail(turns)
    plan = quotations.parsed(mails.withColumnsRenamed({"conv_id": "scope", "turn": "position"}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.turn: r.text for r in mails.where("conv_id = 1").collect()} == {0: "a b", 1: "On Monday the sender wrote:\n> a b\n\nc"}


def test_no_row_is_lost(spark):
    rows = [("l", 0, "one text"), ("l", 0, "another text"), ("l", 0, "one text"), ("l", None, "no number"), ("l", None, "nor here"), (None, None, None), ("l", 1, "> another text\nyes")]
    got = quotations.conversations(spark.createDataFrame(rows, "list string, at long, body string"), "list", "at", "body").collect()
    assert sorted((r.scope or "", r.position is None, r.text, r.n_rows) for r in got) == sorted(
        [("l", False, "one text", 2), ("l", False, "another text", 1), ("l", True, "no number", 1), ("l", True, "nor here", 1), ("", True, "", 1), ("l", False, "yes", 1)])
    answer, said = (next(r for r in got if r.text == text) for text in ("yes", "another text"))
    assert (answer.parent, answer.parent_copy, answer.root_copy) == (0, said.copy, said.copy)


def test_mails_keep_every_row(spark):
    turns = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "c"), (1, None, "d"), (None, 0, "e")], "conv_id long, turn long, text string")
    assert sorted(r.text for r in quotations.as_mail(turns).collect()) == ["On Monday the sender wrote:\n> a\n\nc", "a", "b", "d", "e"]


def test_very_long_texts_and_clashing_columns(spark):
    body = "\n".join(f"line {k} of a very long message" for k in range(20_000))
    rows = [("l", 1, body, 1, "x", "y"), ("l", 2, "> line 7 of a very long message\nindeed", 2, "x", "y")]
    df = spark.createDataFrame(rows, "list string, at long, body string, place int, copy string, root string")
    got = {r.position: r for r in quotations.conversations(df, "list", "at", "body").collect()}
    assert got[2].parent == 1 and got[2].place == 1 and got[1].text == body


def test_the_query_equals_its_sql_on_rows_that_clash(spark, tmp_path):
    import duckdb

    from fleetlens.llm import queries

    turns = [(1, 0, "user", "hello there"), (1, 0, "user", "good day"), (1, 0, "user", "good day"), (1, 1, "assistant", "hello there\nfriend"), (1, 2, "user", None),
             (1, 3, "user", "friend"), (1, None, "user", "hello there"), (1, None, "user", "lost"), (None, 0, "user", "x"), (None, 1, "user", "y"), (2, 5, "user", "  "), (2, 7, "user", "z")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op4_quotations(spark, str(tmp_path)).collect()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = base.execute(queries.SQL["op4_quotations"])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, row)) for row in found.fetchall()]
    assert sum(r["n_rows"] for r in want) == len(turns)
    assert sorted(str(sorted(r.asDict().items())) for r in got) == sorted(str(sorted(r.items())) for r in want)
