"""Queries take whole pages and every conversation turn."""

from lumentrace.plans import core_queries


def test_cracking_takes_short_turns(spark, tmp_path):
    rows = [(1, 0, "user", "Hi there."), (1, 1, "assistant", ""), (2, 0, "user", None), (2, 1, "user", "Please tell me where the old harbour of the town is and how I can get there by train.")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r for r in core_queries.crack_classical(spark, str(tmp_path)).collect()}
    assert set(got) == {(c, t) for c, t, _, _ in rows}


def test_pages_are_read_beyond_their_beginnings(spark, tmp_path):
    noise = "".join(chr(33 + (i * 7919) % 91) for i in range(2000))
    rows = [(1, "u", "a" * 3000 + "\0" + "b" * 100), (2, "u", "a" * 3000), (3, "u", "ab" * 2500 + noise), (4, "u", "ab" * 2500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.is_text for r in core_queries.text_sniff(spark, str(tmp_path)).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r.page_id for r in core_queries.entropy_spike(spark, str(tmp_path)).collect()} == {3}
