import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import chat as C

ODD = st.lists(st.sampled_from([*C.CONTROLS, "\\", "a", " é", "\n", "<", "s>", "[", "INST]", "漢"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "</s>", ""]), ODD)
def test_turns_round_trip(role, text):
    ids, mask, n = C.encode_turn(role, text, C.encoding())
    assert C.decode_turn(ids, C.encoding()) == (role, text)
    rendered = C.render(ids.tolist())
    assert len(rendered) == n and C.unescape(C.escape(text)) == text
    marks = [s for s, marker, _ in C.segments(role, text) if marker]
    parts = C.split(rendered)
    assert parts[1::2] == marks
    assert text in [C.unescape(p) for p in parts[::2]]
    under = ids[mask > 0]
    assert C.unescape(C.encoding().decode_bytes(under.tolist()).decode()) == (text if role == "assistant" else "")
    assert not (under >= C.RESERVED).any()


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b\\"), (1, 1, "user", "a </s>"), (1, 2, "assistant", "b\\"), (2, 1, None, None), (None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 1, "assistant", ""), (4, 1, "tool", "w " * 60000), (4, 2, "assistant", "x" * 20000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, chars int").repartition(5)
    got = {r.conv_id: r for r in C.digests(C.pieces(df)).collect()}
    assert len(got) == 6
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", hashlib.sha256((x[3] or "").encode()).hexdigest()))
        said = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = {r.conv_id: r for r in C.assemble(C.pieces(df)).collect()}
    assert all(len(C.render(whole[k].ids)) == got[k].formatted_chars for k in got)
    assert C.render(whole[1].ids) == "<s>[INST]a \\</s>[/INST]b\\\\</s>b\\\\</s>"
    assert np.array(whole[9].mask).sum() == sum(len(C.encoding().encode_ordinary(f"t{i}")) for i in range(1, 3000, 2))
    assert C.digests(C.pieces(df.limit(0))).count() == 0
