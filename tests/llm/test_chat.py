import random

from tributary.llm import chat_format as chat

HARD = ["", "\\", "\\\\", "</turn>", "<turn>", "a<turn", "\\</turn>", "x\\", "\n", "</turn>\n<turn>user\nhi", "\\### Assistant: </turn> ok", "é\U0001f600"]


def test_round_trip_of_hard_texts():
    for role in ("user", "assistant", "", "a\nb", "<turn>", "r\\"):
        for text in HARD:
            assert [t[:2] for t in chat.parse(chat.render_turn(role, text))] == [(role, text)]


def test_round_trip_of_random_conversations():
    rng = random.Random(3)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "a\nb"]), "".join(rng.choice(["<", "/", "turn>", "<turn>", "</turn>", "\\", "\n", "x"]) for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(4))]
        formatted, loss = chat.format_conversation(turns)
        assert [t[:2] for t in chat.parse(formatted)] == turns
        assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_clean_text_is_not_escaped():
    assert chat.render_turn("user", "plain < text") == "<turn>user\nplain < text</turn>\n"


def test_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string"
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (2, 0, None, None, "x"), (None, 0, "user", "q", "x"), (1, 2, "assistant", "b", "x")]
    out = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame(rows, schema)).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2 and out[2]["n_turns"] == 1 and out[2]["loss_chars"] == 0 and out[None]["n_turns"] == 1
    assert chat.chat_digests(spark.createDataFrame([], schema)).count() == 0
