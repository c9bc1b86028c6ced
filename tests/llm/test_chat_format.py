"""Chats as tables: parts, digests and edges against a plain rendering."""

import hashlib

from gridframe.llm import chat_format
from gridframe.llm.chat_template import unescape

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        conv: (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            sum(len(t) for r, t in turns if r == "assistant"), hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest(),
        )
        for conv, turns in out.items()
    }


ROWS = [
    (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|im_start|> é😀"), (1, 2, None, None), (2, 5, "assistant", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, None, "user", "first"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (3, 0, "assistant", "x" * 50_000), (3, 1, "assistant", "<|" * 20_000), (4, 0, "a\nb\\n", "role with a line end"), (5, 0, "", ""),
]


def check(spark, rows, **options):
    parts = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA), **options)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digest(parts).collect()}
    assert got == plain(rows)
    return parts


def test_edges(spark):
    check(spark, ROWS)


def test_parts_of_a_hot_conversation(spark):
    rows = ROWS + [(7, k, "assistant" if k % 2 else "user", f"<|turn {k}|>") for k in range(4_000)]
    parts = check(spark, rows, part_chars=2_000)
    hot = [r for r in parts.collect() if r["conv_id"] == 7]
    assert len(hot) > 20 and [r["part"] for r in sorted(hot, key=lambda r: r["part"])] == list(range(len(hot)))
    assert max(len(r["text"]) for r in hot) < 2_200
    for r in hot:
        assert all(unescape(r["text"][s["start"] : s["end"]]).startswith("<|turn ") for s in r["spans"])


def test_turns_come_back_as_rows(spark):
    parts = chat_format.format_conversations(spark.createDataFrame(ROWS, SCHEMA), part_chars=100)
    found = chat_format.read_turns(parts).collect()
    assert sorted((repr(r["conv_id"]), r["role"], r["text"]) for r in found) == sorted((repr(c), r or "", t or "") for c, _, r, t in ROWS)
    assert all(r["learned"] == (r["role"] == "assistant" and r["text"] != "") for r in found)


def test_other_templates(spark):
    source = "{% if messages[0].role == 'user' %}[B]{% endif %}{% for m in messages %}{% generation %}{{ m.text | trim }}{% endgeneration %};{{ loop.revindex }} {% endfor %}"
    parts = chat_format.format_conversations(spark.createDataFrame([(1, 1, "assistant", " b "), (1, 0, "user", "a")], SCHEMA), template=source).collect()
    assert [r["text"] for r in parts] == ["[B]a;2 b;1 "]


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.digest(chat_format.format_conversations(empty)).collect() == []
    wide = spark.createDataFrame([(1, 0, "user", "t", 9, "x", 3)], SCHEMA + ", part long, spans string, messages long")
    assert chat_format.digest(chat_format.format_conversations(wide)).count() == 1


def test_the_query_adds_the_marked_conversation(spark, sf_dir):
    row = chat_format.query(spark, sf_dir).where("conv_id = -1").first()
    turns = [("user", chat_format.MARKED), ("assistant", chat_format.MARKED)]
    assert row["n_turns"] == 2 and row["loss_chars"] == len(chat_format.MARKED)
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(chat_format.MARKED.encode()).hexdigest()
