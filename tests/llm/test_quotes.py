import duckdb
import pytest

from lectern.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, parent_turn string"
THREAD = [
    (1, 0, "user", "Shall we meet on Monday?\nI can bring the plan."),
    (1, 1, "assistant", "> Shall we meet on Monday?\n\nYes, at nine."),
    (1, 2, "user", ">> shall  we MEET on Monday?\n> Yes, at nine.\n\nFine with me."),
    (1, 3, "other", "> I can bring the plan.\nPlease do."),
    (1, 4, "user", "> > Shall we meet on Monday?\r\n> Fine with me.\r\n\r\nSee you"),
    (1, 5, "user", "> nobody said this\nHm."),
    (1, 6, "user", "> Shall we meet on Monday?\n> I can bring the plan.\n> Please do.\nAgreed"),
    (2, 0, "user", "Fine with me."),
    (2, 1, "user", ">Fine with me."),
    (2, 2, None, None),
    (2, 3, "user", ""),
    (2, 4, "user", ">>>\n>\n> "),
    (2, 5, "user", "  > Fine with me.\n> Fine with me.\nboth"),
    (3, 1, "user", "> said later\nx"),
    (3, 2, "user", "said later"),
    (3, 3, "user", "same"),
    (3, 3, "user", "> said later\nsame"),
    (3, 3, "user", "> said later\nsame"),
    (None, 1, "user", "> a"),
    (4, None, "user", "a"),
    (5, 0, "user", "line\n" * 3000),
    (5, 1, "user", "> line\n" * 3000 + ">> deeper\n" + "end"),
]


def frame(spark, rows=THREAD):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_replies(spark):
    found = {(r.conv_id, r.turn): r for r in quotes.conversations(frame(spark)).collect()}
    parent = {k: r.parent_turn for k, r in found.items()}
    assert [parent[1, t] for t in range(7)] == [None, 0, 1, 0, 2, None, 0]
    assert [found[1, t].root_turn for t in range(7)] == [0, 0, 0, 0, 0, 5, 0]
    assert parent[2, 1] == 0 and parent[2, 5] == 0 and parent[3, 1] is None and parent[5, 1] == 0
    assert found[1, 2].text == "Fine with me." and found[1, 1].formatted == "<|assistant|>\nYes, at nine.\n"
    assert found[2, 2].text == found[2, 4].text == ""


def test_equals_sql(spark):
    messages = frame(spark)
    found = quotes.conversations(messages)
    conversations = messages.toPandas()  # noqa: F841
    wanted = duckdb.connect().execute("create table conversations as select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, role, text from conversations").execute(quotes.SQL)
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in found.select(names).collect()) == key(wanted.fetchall())


@pytest.mark.parametrize("depth", [1, 2, 17])
def test_roots_of_chains(spark, depth):
    rows = [(1, 0, "user", "message number 0")]
    rows += [(1, i, "user", f"> message number {i - 1}\nmessage number {i}") for i in range(1, depth)]
    found = quotes.conversations(frame(spark, rows)).collect()
    assert {r.root_turn for r in found} == {0}
    assert sorted(r.parent_turn for r in found if r.turn) == list(range(depth - 1))


def test_common_passage_links_once(spark):
    rows = [(1, t, "user", "ok" if t % 2 == 0 else "> ok\nok") for t in range(200)]
    found = quotes.conversations(frame(spark, rows)).collect()
    assert len(found) == 200 and all(r.parent_turn == 0 for r in found if r.turn % 2)


def test_empty_table(spark):
    assert quotes.conversations(frame(spark).limit(0)).count() == 0


def test_only_dataframe_operations(spark):
    plan = quotes.conversations(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
