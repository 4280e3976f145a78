import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A\t\n\x0b\x1c\xa0é漢-.", max_size=30)), max_size=8)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    array = pa.array(texts, pa.string())
    for part in (array, array.slice(1)):
        own = texts if part is array else texts[1:]
        h, starts = W.hashed(part)
        assert np.diff(starts).tolist() == [len(split(t)) for t in own]
        flat = [w for t in own for w in split(t)]
        assert [a == b for a in flat for b in flat] == [a == b for a in h.tolist() for b in h.tolist()]
        s, before = W.windows(h, starts, 3)
        runs = [tuple(ws[i : i + 3]) for t in own for ws in [split(t)] for i in range(len(ws) - 2)]
        assert before[-1] == len(runs) and len(set(runs)) == len(set(s.tolist()))
        lower, _ = W.hashed(part, fold=True)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in flat]
        assert len(set(low)) == len(set(lower.tolist()))


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (1, 5, 100, 2, 3, 0)] + [None], "k": list(range(7))})
    parts = list(W.chunks(batch, most=10))
    assert [k for p in parts for k in p.column(1).to_pylist()] == list(range(7))
    assert [p.num_rows for p in parts] == [2, 1, 4]


def test_a_task_gives_free_memory_back_when_it_ends(monkeypatch):
    said = []

    class Pool:
        def release_unused(self):
            said.append("released")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    for x in W.returning(lambda batches: (2 * b for b in batches))(iter([1, 2])):
        said.append(x)
    assert said == [2, 4, "released"]
