import hashlib
import random
from collections import defaultdict

import pytest

from plotgrid.llm import chat
from plotgrid.llm.registry import QUERIES

GRAMMAR = chat.Grammar()
PARTS = [*chat.Template().controls, "<\\s>", "[\\\\INST]", "\\", "<", "[", ">", "/s>", "INST]", " ", "\n", "a", "é", "🙂", " [/INST]", "\n<</SYS>>\n", "ROLE]"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """The result's columns but formatted_chars, from the source rows."""
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in chats.items():
        turns.sort()
        learned = "".join(text for *_, role, text in turns if role == "assistant")
        out.add((conv, len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), digest(learned)))
    return out


def test_any_turn_comes_back():
    rng = random.Random(3)
    for _ in range(20_000):
        role = rng.choice(["system", "user", "assistant", "tool", "", "".join(rng.choices(PARTS, k=2))])
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 6)))
        written, begin, end = GRAMMAR.turn(role, text)
        assert [t[:2] for t in GRAMMAR.parse(written)] == [(role, text)]
        assert GRAMMAR.unescape(written[begin:end]) == text
        assert not any(c in written[begin:end] for c in chat.Template().controls)


def test_turns_come_back_from_a_whole_chat():
    rng = random.Random(5)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "x"]), "".join(rng.choices(PARTS, k=rng.randint(0, 5)))) for _ in range(rng.randint(0, 9))]
        whole = "".join(GRAMMAR.turn(*t)[0] for t in turns)
        assert [t[:2] for t in GRAMMAR.parse(whole)] == turns


def test_only_conflicts_are_escaped():
    assert GRAMMAR.turn("user", "a < b [ c \\ </ s>")[0] == "<s>[INST] a < b [ c \\ </ s> [/INST]"
    assert GRAMMAR.turn("assistant", "</s>")[0] == "<s> <\\/s></s>"
    assert GRAMMAR.turn("assistant", "<\\/s>")[0] == "<s> <\\\\/s></s>"


@pytest.mark.parametrize("bad", ["x", "<s>[INST] a", "<s> a<s> b</s>", "<s>[INST] [/INST] [/INST]", "<s> a</s>b", "<s>[ROLE]x</s>", "<s>[INST][/INST]"])
def test_other_text_is_refused(bad):
    with pytest.raises(chat.BadChat):
        list(GRAMMAR.parse(bad))


def test_query_against_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = QUERIES["op12_chat_formatting"](spark, sf_dir).collect()
    assert {tuple(r)[:5] for r in got} == plain(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    own = next(r for r in got if r.conv_id == -7)
    assert own.loss_sha256 == digest(said) and own.formatted_chars > 2 * len(said)


def test_odd_rows_and_a_hot_conversation(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), "".join(rng.choices(PARTS, k=4))) for i in range(3000)]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (2, 0, None, "x"), (2, None, "assistant", "first"), (2, 1, "assistant", "long " * 40_000)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (3, 7, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as part", "'clash' as loss", "'clash' as formatted").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables this small would be joined to one part
    pieces = chat.cut_lineage(chat.format_chats(frame, piece_chars=500), "chats")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = pieces.where("conv_id = 1")
    assert hot.select("part").distinct().count() > 1 and hot.selectExpr("max(length(formatted))").first()[0] < 1000
    assert {tuple(r)[:5] for r in chat.read_chats(pieces).collect()} == plain(rows)
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
