from pyspark.sql import functions as F

from emberline.llm import chat_format as c


def chat(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def spans(turns):
    return ",".join(f"{13 + len(r or '')}:0,{len(t or '') + 11}:{int(r == 'assistant')}" for r, t in turns)


def test_pairs(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    cases = [([u, a], [u, b]), ([u, a], [u, a]), ([u], [u, b]), ([], [u]), (None, [u, a]), ([u, a, u, a], [u, a, u, b, u]), ([(None, None), a], [(None, None), b]), ([("user", "é漢")], [("user", "é")])]
    rows = spark.createDataFrame([(i, x, y, "clash") for i, (x, y) in enumerate(cases)], f"id int, chosen {c.TURNS}, rejected {c.TURNS}, prompt string")
    for r in c.format_preferences(rows).collect():
        x, y = cases[r.id][0] or [], cases[r.id][1] or []
        n = 0
        while n < min(len(x), len(y)) and chat(x[n : n + 1]) == chat(y[n : n + 1]):
            n += 1
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, chat(x[:n]), chat(x[n:]), chat(y[n:]))
        assert (r.chosen_mask, r.rejected_mask) == (spans(x[n:]), spans(y[n:]))


def test_gathering_and_earlier_replies(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second"), (2, 0, "user", "alone"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (None, None, None, None)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    rows = {r.conv_id: r for r in c.with_earlier_reply(c.gathered(t)).collect()}
    assert [x.text for x in rows[1].rejected] == ["q", "first", "r", "first"] and [x.text for x in rows[1].chosen][-1] == "second"
    assert rows[2].rejected == rows[2].chosen and [x.text for x in rows[3].rejected] == ["a", ""]
    assert len(rows[None].chosen) == 1
    assert c.gathered(t.limit(0)).collect() == []


def test_sql_gives_the_same(spark, sf_dir):
    import duckdb

    from emberline.llm import queries

    d = duckdb.connect()
    d.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = d.execute(queries.SQL["op7_chat_format"]).df()
    got = queries.QUERIES["op7_chat_format"](spark, sf_dir).toPandas()
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))


def test_null_texts_equal_the_sql(spark):
    """Turns without text or role, with a null reply, and repeated rows, against the query's SQL."""
    import duckdb
    import pandas as pd

    from emberline.llm import queries

    turns = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "assistant", None), (3, 0, None, None), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (4, 1, "assistant", None)]
    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"])
    d = duckdb.connect()
    d.register("conversations", conversations)
    want = d.execute(queries.SQL["op7_chat_format"])
    columns = [x[0] for x in want.description]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = c.format_preferences(c.with_earlier_reply(c.gathered(table))).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
