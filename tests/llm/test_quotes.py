"""Quotes that are cut, that stand in other conversations, and that are short."""

from earshot.llm import quotes


def test_trimmed_far_and_short_quotes(spark):
    three = "The first line of this text\nThe second line of this text\nThe third line of this text"
    paragraphs = "A paragraph about apples\n\nA paragraph about pears\n\nA paragraph about plums"
    rows = [
        (1, 0, three), (1, 1, paragraphs), (1, 2, "Unrelated words in between"),
        (1, 3, "> The first line of this text\n> The second line of this text\nTwo of three lines"),
        (1, 4, "> A paragraph about apples\n>\n> A paragraph about pears\nTwo of three paragraphs"),
        (1, 5, "Yes."), (1, 6, "> Yes.\nWhy?"),
        # the smallest conversation with the passage is the quoting one, where it comes later
        (2, 0, "> A passage that many have written\nI saw this"), (2, 1, "A passage that many have written"),
        (3, 7, "A passage that many have written"), (4, 0, "A passage that many have written"),
        (5, 0, "> Yes.\nShort and from nowhere"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to_conv, r.reply_to_turn) for r in quotes.conversations(df).collect()}
    assert len(got) == len(rows)
    linked = {k: v for k, v in got.items() if v != (None, None)}
    assert linked == {(1, 3): (1, 0), (1, 4): (1, 1), (1, 6): (1, 5), (2, 0): (3, 7)}
