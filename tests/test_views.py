"""The driver's tables seen as pull requests."""

from reviewloom.plans import views


def test_all_turns_of_a_long_conversation_are_comments(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1, 1502)] + [(2, 1, "user", "only a title")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.pull_number: r for r in views.pulls(spark, str(tmp_path)).collect()}
    assert [c.body for c in got[1].comments] == [f"turn {t}" for t in range(2, 1502)]
    assert got[2].title == "only a title" and got[2].comments == []
