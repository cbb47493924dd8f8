import os
import random
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from logspark.llm import chat_quotes as Q  # noqa: E402
from logspark.llm import oracles  # noqa: E402
from oracle_check import rows_of  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def quote(text, mark="> "):
    return "\n".join(mark + line for line in text.split("\n"))


def by_turn(spark, rows):
    return {(r["conv_id"], r["turn"]): r for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_nested_quotes_lead_to_their_messages(spark):
    first, second = "How do I sort a list?\nIt is long.", "Use sorted."
    rows = [(1, 0, "user", first), (1, 1, "user", "Unrelated."), (1, 2, "assistant", quote(first) + "\n" + second),
            (1, 3, "user", "On Monday, Bo wrote:\n" + quote(quote("how do I  sort a list?")) + "\n" + quote(second) + "\nThanks"),
            (1, 4, "user", quote("nobody said this") + "\nend"), (2, 0, "user", quote(second))]
    out = by_turn(spark, rows)
    assert [out[1, t]["parent_turn"] for t in range(5)] == [None, None, 0, 2, None]
    assert [out[1, t]["root_turn"] for t in range(5)] == [0, 1, 0, 0, 4]
    assert [out[1, t]["position"] for t in range(5)] == [0, 3, 1, 2, 4]
    assert out[1, 3]["text"] == "Thanks" and out[1, 2]["text"] == second and out[2, 0]["parent_turn"] is None


@pytest.mark.parametrize("block", [10_000, 2])
def test_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng, rows = random.Random(4), []
    words = "alpha beta gamma delta".split()
    for conv in range(30):
        texts = []
        for turn in range(rng.randint(1, 12)):
            text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 4)))
            if texts and rng.random() < 0.6:
                lines = rng.choice(texts).split("\n")
                at = rng.randrange(len(lines))
                part = "\n".join(lines[at:at + rng.randint(1, 5)])
                text = rng.choice(("Le 3 mai, Ann a écrit :\n", "")) + quote(part, rng.choice(("> ", ">", " > "))) + "\n" + text
            texts.append(text)
            rows.append((conv, turn, "user", text))
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", frame)
    cur = con.execute(oracles.CHAT)
    expected = rows_of([d[0] for d in cur.description], cur.fetchall())
    out = Q.reply_order(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == expected


def test_paragraphs_wrapped_anew_lead_to_their_message(spark):
    parts = ["Hello all,", "the first part is long and\nruns over two lines.", "The second part runs over\ntwo lines as well.", "Bye\nAnn"]
    again = ["the first part\nis long and runs over two\nlines.", "The second part\nruns over two lines as well."]
    rows = [(1, 0, "user", "\n\n".join(parts)), (1, 1, "user", "Something else."),
            (1, 2, "user", quote("\n\n".join(again)) + "\nYes."),                       # without greeting and name
            (1, 3, "user", quote(quote("\n\n".join(again)) + "\nYes.") + "\nNo."),
            (1, 4, "user", quote("nobody\nsaid this\n\nThe  second part runs\nover two lines as well.\n\nor this\none") + "\nBut."),
            (2, 0, "user", "\n\n".join(parts)), (2, 1, "user", parts[1]),
            (2, 2, "user", quote("\n\n".join(parts)) + "\nas it stands"),                # the whole message: as before
            (2, 3, "user", quote("\n\n".join(parts[1:3])) + "\nwith its own lines")]     # found line by line: as before
    out = by_turn(spark, rows)
    assert [out[1, t]["parent_turn"] for t in range(5)] == [None, None, 0, 2, 0]
    assert [out[1, t]["root_turn"] for t in range(5)] == [0, 1, 0, 0, 0]
    assert [out[1, t]["position"] for t in range(5)] == [0, 4, 1, 2, 3]
    assert [out[1, t]["n_linked"] for t in (2, 3, 4)] == [2, 3, 1]
    assert [out[1, t]["n_quoted"] for t in (2, 4)] == [1 + 5 + 2, 1 + 6 + 1]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame([r for r in rows if r[0] == 2], columns=["conv_id", "turn", "role", "text"]))
    cur = con.execute(oracles.CHAT)
    expected = rows_of([d[0] for d in cur.description], cur.fetchall())
    names = sorted(out[2, 0].asDict())
    assert rows_of(names, [tuple(r[n] for n in names) for k, r in out.items() if k[0] == 2]) == expected


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, "user", None), (1, 0, None, ""), (1, 0, None, ""), (1, 1, "user", "> "),
            (1, 2, "user", ">" * 50 + " deep"), (2, 0, "user", "x y\n" * 20_000), (2, 1, "user", "> x y\nyes")]
    out = Q.reply_order(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS root", "2 AS conv", "3 AS level")).collect()
    assert len(out) == 8
    assert sorted(r["position"] for r in out if r["conv_id"] == 1) == [0, 1, 2, 3]
    assert [r["parent_turn"] for r in out if r["conv_id"] == 2 and r["turn"] == 1] == [0]
    assert sorted((r["turn"] is None, r["position"]) for r in out if r["conv_id"] is None) == [(False, 1), (True, 0)]


def test_conversations_named_by_texts(spark):
    long = "thread-" + "x" * 100
    rows = [(long, 0, "user", "first words"), (long, 1, "user", "> first words\nyes"), ("7", 0, "user", "a"), ("", 0, "user", "b"), (None, 0, "user", "c")]
    docs = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    out = {(r["conv_id"], r["turn"]): r for r in Q.reply_order(docs).collect()}
    assert set(out) == {(long, 0), (long, 1), ("7", 0), ("", 0), (None, 0)}
    assert out[long, 1]["parent_turn"] == 0 and out[long, 1]["text"] == "yes"


def test_empty_table_and_native_plan(spark):
    empty = Q.reply_order(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    plan = Q.reply_order(spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
