"""Turns out of records of several layouts, chosen by fingerprint."""

from pyspark.sql import functions as F

from firmgraph.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


def test_each_layout_is_found_and_read_back(spark):
    roles = ["user", "assistant", "system", "human", "gpt", "", None]
    rows = [(c, t, role, x) for c in [*range(6), -1, None] for t, (role, x) in enumerate((r, v) for r in roles for v in ("a<|im_end|>", "", None, "\n{\"x\": 1}"))]
    got = cf.format_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["schema"]["layout"] for r in got} == {"turn", "messages", "from-value"} and len({r["schema"]["fingerprint"] for r in got}) == 3
    for r in got:
        assert [(t["role"], t["text"]) for t in r["schema"]["turns"]] == [(r["role"], r["text"])]
        assert [(role, body) for role, body, _, _ in cf.parse_formatted(r["formatted"])] == [(r["role"], r["text"])]


def test_long_conversations_keep_their_digests(spark):
    rows = [(i % 3, t, "assistant" if t % 2 else "user", "é" * (50_000 if t == 1 else 3)) for i in range(3) for t in range(40)]
    got = {r["conv_id"]: r for r in cf.conversation_digests(cf.format_rows(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c in range(3):
        said = [x for i, _, role, x in sorted(rows) if i == c and role == "assistant"]
        assert got[c]["n_turns"] == 40 and got[c]["loss_chars"] == sum(map(len, said))
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: cf.conversation_digests(cf.format_rows(d))).agg(F.count("*")).first()[0] == 0
