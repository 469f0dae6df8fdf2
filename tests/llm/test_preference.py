"""Preference pairs: prefix, masks, odd rows."""

from pressgauge.llm import preference, queries

SCHEMA = "pair_id long, turn long, role string, text string, prompt int"


def frames(spark, chosen, rejected):
    return [spark.createDataFrame([(*r, 1) for r in rows], SCHEMA) for rows in (chosen, rejected)]


def test_prefix_is_rendered_once_and_masks_cover_the_answers(spark):
    shared = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")]
    chosen = [*shared, (1, 2, "user", "more"), (1, 3, "assistant", "good 🙂")]
    rejected = [*shared, (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "user", "?")]
    (row,) = preference.format_pairs(*frames(spark, chosen, rejected)).collect()
    assert row.n_common == 3
    assert row.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert [row.chosen[r.start : r.end] for r in row.chosen_mask] == ["good 🙂<|end|>\n"]
    assert [row.rejected[r.start : r.end] for r in row.rejected_mask] == ["bad<|end|>\n"]
    assert row.rejected.endswith("<|user|>\n?<|end|>\n")


def test_odd_rows(spark):
    chosen = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "only chosen"),
        (4, 0, "user", "same"), (None, 0, "user", "no pair"), (5, 0, "user", "x" * 100_000),
    ]
    rejected = [(1, 0, "user", "a"), (1, None, None, ""), (3, 0, "assistant", "only rejected"), (4, 0, "user", "same"), (5, 0, "assistant", "")]
    rows = {r.pair_id: r for r in preference.format_pairs(*frames(spark, chosen, rejected)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].n_common == 2 and rows[1].prompt.startswith("<|unknown|>\n<|end|>\n")
    assert rows[1].chosen == "<|user|>\na<|end|>\n" and rows[1].rejected == ""
    assert rows[2].n_common == 0 and rows[2].rejected == "" and rows[2].prompt == ""
    assert rows[3].chosen == "" and len(rows[3].rejected_mask) == 1
    assert rows[4].n_common == 1 and rows[4].chosen == rows[4].rejected == ""
    assert len(rows[5].chosen) > 100_000


def test_rejected_side_has_the_next_answer(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "again"), (1, 3, "assistant", "two"), (2, 0, "user", "q"),
        (2, 1, "assistant", "other"), (3, 0, "user", "alone"), (5, 0, "assistant", None), (5, 0, "assistant", "x"), (None, 0, "assistant", "y"),
        (6, None, "assistant", "z"),
    ]
    chosen, _ = frames(spark, rows, [])
    other = preference.with_other_answer(chosen)
    assert sorted(map(tuple, other.collect()), key=str) == sorted(
        [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "again"), (1, 3, "assistant", "other"), (2, 0, "user", "q"),
         (2, 1, "assistant", ""), (3, 0, "user", "alone"), (5, 0, "assistant", ""), (5, 0, "assistant", ""), (6, None, "assistant", "z")],
        key=str,
    )
    found = {r.pair_id: r for r in preference.format_pairs(chosen, other).collect()}
    assert [found[i].n_common for i in (1, 2, 3, 5, 6)] == [3, 1, 1, 1, 1]


def test_prefixes_of_many_lengths_on_the_given_table(spark):
    rows = queries.op3_preference_pairs(spark, "/root/testdata/sf0.01").collect()
    assert len({r.n_common for r in rows}) >= 4
    assert sum(r.prompt != "" for r in rows) > 0.9 * len(rows)
    assert all(r.chosen != r.rejected for r in rows if r.chosen_mask)


def test_empty_tables(spark):
    assert preference.format_pairs(*frames(spark, [], [])).count() == 0
    assert preference.with_other_answer(frames(spark, [], [])[0]).count() == 0
