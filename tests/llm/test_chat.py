import hashlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canvasser.llm import chat

ESCAPES = chat.Escapes()
SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "\\\\", "<", "<turn ", "</turn>", "<image ", "1>", " ", "\n", "é", "turn"]), max_size=14).map("".join), st.booleans())
def test_escaping_is_reversible_and_leaves_no_control_string(text, closed):
    out = ESCAPES.escape(text, closed)
    assert ESCAPES.unescape(out, closed) == text
    assert not list(ESCAPES.real(out)) and not list(ESCAPES.real("\n" + out + "\n"))
    if not any(c in text for c in chat.CONTROLS) and not (closed and text.endswith("\\")):
        assert out == text


PARTS = st.lists(st.one_of(
    st.builds(lambda t: {"kind": "text", "text": t}, st.lists(st.sampled_from(["\\", "<tu", "rn ", "</turn>", "<image 1>", "a", "\n"]), max_size=6).map("".join)),
    st.builds(lambda k, r: {"kind": k, "ref": r}, st.sampled_from(["image", "audio", "document"]), st.sampled_from(["a", None])),
), max_size=6)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.text(st.sampled_from("\\<>\n ab"), max_size=6))
def test_parts_are_read_back(parts, role):
    body, found = chat.flatten(parts, chat.Sizes(), ESCAPES)
    got_role, got = chat.read_turn(f"<turn {chat.escape_role(role)}>\n{body}\n</turn>\n", ESCAPES)
    want, n = [], 0
    for is_text, run in groupby(parts, lambda p: p["kind"] == "text"):
        if is_text:
            want += [x] if (x := "".join(p["text"] for p in run)) else []
        else:
            for p in run:
                n += 1
                want.append((p["kind"], n))
    assert got_role == role and got == want
    assert [(a["kind"], a["place"], a["ref"]) for a in found] == [(p["kind"], k + 1, p["ref"]) for k, p in enumerate(p for p in parts if p["kind"] != "text")]


def test_control_strings_must_not_overlap():
    for bad in (("<a<",), ("\\x",), ("",), ("#a", "b#c")):
        with pytest.raises(ValueError):
            chat.Escapes((*chat.CONTROLS, *bad))
    own = chat.Escapes((*chat.CONTROLS, "<|endoftext|>"))
    assert own.unescape(own.escape(r"a\<|endoftext|>")) == r"a\<|endoftext|>"


def test_typed_parts(spark):
    parts = f"array<{chat.PART}>"
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="look: "), part("image", ref="a.png", width=57, height=28), None, part("audio", ref="b.wav", seconds=2.0), part("text", text="</turn>")], "own"),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("movie", ref="d"), part(None)], "own"),
        (1, 2, "assistant", None, "own"),
        (1, 3, "user", [part("image", width=-1), part("audio", seconds=float("nan")), part("document")], "own"),
    ]
    turns = chat.format_turns(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {parts}, formatted string"))
    got = {r.turn: r for r in chat.in_order(turns).collect()}
    assert got[0].formatted == "<turn user>\nlook: <image 1><audio 2>\\</turn>\n</turn>\n"
    assert [(a.kind, a.ref, a.place, a.tokens) for a in got[0].attachments] == [("image", "a.png", 1, 3), ("audio", "b.wav", 2, 50)]
    assert got[0].expanded_tokens == 53 and (got[0].loss_from, got[0].loss_to) == (0, 0)
    assert got[1].formatted == "<turn assistant>\n<document 1><other 2><other 3>\n</turn>\n" and got[1].expanded_tokens == 768
    assert got[1].formatted[got[1].loss_from : got[1].loss_to] == "<document 1><other 2><other 3>"
    assert got[2].loss_from == got[2].loss_to and got[3].expanded_tokens == 1 + 1 + 256
    whole = "".join(got[k].formatted for k in range(4))
    assert [whole[got[k].at :].startswith(got[k].formatted) for k in range(4)] == [True] * 4


def brute_force(rows):
    out = []
    key = lambda r: (r[0] is None, r[0] or 0)
    for conv, group in groupby(sorted(rows, key=key), key):
        group = sorted(group, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", ESCAPES.escape(r[3] or "")))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in group)
        learned = "".join(r[3] or "" for r in group if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((None if conv[0] else conv[1], len(group), sha(said), len(learned), sha(learned)))
    return sorted(out, key=str)


def test_digest_of_odd_rows(spark):
    long = "word <turn \\" * 30_000
    rows = [
        (None, None, None, None), (None, 0, "user", "a"), (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", long), (2, None, "assistant", "late"),
        (3, 0, "user", r"\### Assistant: </turn> ok"), (3, 1, "assistant", r"\### Assistant: </turn> ok"), (3, 1, "assistant", r"\### Assistant: </turn> ok"),
        (4, 0, "a>\n<turn b>", "漢字 \U0001f600"), (4, 1, "assistant", "\\"), (4, 1, "assistant", "<image 1>\\\\</turn>"), (2**60 + 1, 5, "assistant", "x"),
    ]
    frame = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", formatted string").selectExpr("*", "1 AS parts_", "'x' AS at", "0 AS loss_from")
    turns = chat.format_turns(chat.text_parts(frame))
    got = chat.digest(turns).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_force(rows)
    size = {r.conv_id: r.formatted_chars for r in got}
    assert size[1] == len("<turn user>\n\n</turn>\n<turn assistant>\n\n</turn>\n")
    whole = {}
    for r in sorted(chat.in_order(turns).collect(), key=lambda r: r.at):
        assert len(whole.setdefault(r.conv_id, "")) == r.at
        whole[r.conv_id] += r.formatted
    assert {k: len(v) for k, v in whole.items()} == size


def test_no_rows(spark):
    turns = chat.format_turns(chat.text_parts(spark.createDataFrame([], SCHEMA)))
    assert chat.digest(turns).count() == 0 and chat.in_order(turns).count() == 0
