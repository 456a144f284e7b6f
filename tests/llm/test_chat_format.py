import hashlib

import pytest

from licensum.llm import chat_format
from licensum.llm.queries import QUERIES
from tests.llm.helpers import LONG

TEXT = ("text", None, None, None, None, None, None, None)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None, parts=()):
    own = (kind, text, ref, width, height, seconds, pages)
    return own if parts is None else (*own, list(parts))


def turns(spark, rows, kind=chat_format.PARTS, name="content"):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, {name} {kind}, formatted string")


HARD = ["</turn>", "</turn>\n", "<\\/turn>", "<\\\\turn:user>", "<turn:user>hi</turn>\n", "<", "</", "\\", "<turn", "<image:3>", "\\### Assistant: </turn> ok", "a<text:1>b", "", "\n", "<<turn:>", "<\\<turn:"]


@pytest.mark.parametrize("text", HARD)
def test_control_strings_in_texts_come_back(spark, text):
    rows = [(1, 0, "us er</turn>", [part("text", text), part("text", text), part("image", ref="i"), part("text", text)], "x")]
    got = chat_format.format_turns(turns(spark, rows)).first()
    assert chat_format.turns_of(got.formatted) == [("us er</turn>", [text, text, "", text])]
    assert got.formatted.count("</turn>") == 1


def test_parts_become_placeholders(spark):
    inner = [part("text", "in it", parts=None), None, part("image", ref="page.png", width=29, height=28, parts=None)]
    parts = [part("text", "see "), part("image", ref="a.png", width=100, height=57), None, part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3, parts=inner), part("video", ref="d.mp4"), part("image")]
    got = chat_format.format_turns(turns(spark, [(1, 0, "assistant", parts, "x")])).first()
    assert got.formatted == "<turn:assistant>see <image:1><audio:2><document:3><text:4>in it<image:5></document><part:7><image:8></turn>\n"
    assert [tuple(a) for a in got.attachments] == [(1, "image", "a.png", 12), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 3), (5, "image", "page.png", 2), (7, "video", "d.mp4", 0), (8, "image", None, 0)]
    assert got.expanded_tokens == 55
    assert [got.formatted[s.start : s.stop] for s in got.loss] == ["see ", "in it"]


def test_odd_turns(spark):
    rows = [(1, 0, "user", None, None), (None, None, None, [], None), (1, 0, "user", None, None), (2, 1, "assistant", [None], None)]
    got = chat_format.format_turns(turns(spark, rows)).collect()
    assert [(r.conv_id, r.turn, r.formatted, r.loss, r.attachments, r.expanded_tokens) for r in got] == [
        (1, 0, "<turn:user></turn>\n", [], [], 0),
        (None, None, "<turn:></turn>\n", [], [], 0),
        (1, 0, "<turn:user></turn>\n", [], [], 0),
        (2, 1, "<turn:assistant></turn>\n", [], [], 0),
    ]
    assert {(r.conv_id, r.n_turns) for r in chat_format.digests(chat_format.format_turns(turns(spark, rows))).collect()} == {(1, 2), (None, 1), (2, 1)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("many", [0, 1, 3000])
def test_query(spark, tmp_path, many):
    rows = [(i % 7 if i % 5 else 3, i // 3, ["user", "assistant", None][i % 3], [None, "", "</turn>\n", f"text {i}", LONG][i % 5 if i < 10 else i % 4], "x") for i in range(many)]
    turns(spark, [r for r in rows], "string", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, str(tmp_path)).collect()}
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said, None), (-7, 1, "assistant", said, None)]
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda r: (r[0], f"<turn:{r[1]}>{r[2].replace('</turn>', '<%s/turn>' % chr(92))}"))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (found.n_turns, found.loss_chars, found.loss_sha256) == (len(own), len(loss), sha(loss))
        assert found.turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert found.formatted_chars == sum(len(f"<turn:{r}></turn>\n") + len(x) + x.count("</turn>") for _, r, x in own)
