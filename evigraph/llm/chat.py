r"""Chat formatting by token-level assembly.

Template: ``<s>``, then the turns by their order: a user's ``[INST]text[/INST]``, an assistant's ``text</s>``, any other role's
``<|role|>role<|text|>text</s>``. Each marker is one reserved id behind the tokenizer's own; roles and texts are encoded each for
itself, so no token spans a border and no text can yield a reserved id.

Control strings in a text are escaped, so that the rendered string can be read back too: of n backslashes before a control string
2 n + 1 are written, of n at the text's end 2 n. A run of backslashes before a marker is thus even, before escaped text odd.

The output is a table of pieces, one for each turn and one for each beginning, so a conversation of any length needs no more memory
than its longest turn. The loss mask marks the ids of assistants' texts: +1 where one begins and -1 behind its end, summed up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|role|>", "<|text|>")
RESERVED = 50_257
IDS = {c: RESERVED + i for i, c in enumerate(CONTROLS)}
#: The word pattern that goes with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})|(\\+)\Z")
_MARK = re.compile(rf"(\\*)({_CONTROL})")

_encodings: dict[str, object] = {}


def encoding(folder: str = TOKENIZERS):
    if folder not in _encodings:
        import tiktoken

        with open(f"{folder}/{VOCABULARY}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[folder] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[folder]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2] if m[2] else m[3] * 2, text)


def unescape(text: str) -> str:
    return re.sub(rf"(\\+)(?:({_CONTROL})|\Z)", lambda m: m[1][: len(m[1]) // 2] + (m[2] or ""), text)


def split(rendered: str) -> list[str]:
    """Markers and escaped texts of a rendered string, in turn; only markers with an even number of backslashes before them count."""
    out, begin = [], 0
    for m in _MARK.finditer(rendered):
        if len(m[1]) % 2 == 0:
            out += [rendered[begin : m.start(2)], m[2]]
            begin = m.end()
    return [*out, rendered[begin:]]


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, whether it is a marker, whether it counts for the loss) of a turn; the strings are escaped."""
    if role == "user":
        return [("[INST]", True, False), (escape(text), False, False), ("[/INST]", True, False)]
    if role == "assistant":
        return [(escape(text), False, True), ("</s>", True, False)]
    return [("<|role|>", True, False), (escape(role), False, False), ("<|text|>", True, False), (escape(text), False, False), ("</s>", True, False)]


def encode_turn(role: str, text: str, enc) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, loss mask and rendered length of a turn."""
    ids, steps, n = [], [], 0
    for string, marker, loss in segments(role, text):
        own = [IDS[string]] if marker else enc.encode_ordinary(string)
        if loss:
            steps += [(len(ids), 1), (len(ids) + len(own), -1)]
        ids += own
        n += len(string)
    change = np.zeros(len(ids) + 1, np.int8)
    for at, by in steps:
        change[at] += by
    return np.array(ids, np.int32), np.cumsum(change[:-1], dtype=np.int8), n


def decode_turn(ids: np.ndarray, enc) -> tuple[str, str]:
    """Role and text of a turn's ids."""
    at = np.flatnonzero(ids >= RESERVED)
    plain = lambda a, b: unescape(enc.decode_bytes(ids[a:b].tolist()).decode())
    if ids[0] == IDS["[INST]"]:
        return "user", plain(1, len(ids) - 1)
    if ids[0] == IDS["<|role|>"]:
        return plain(1, at[1]), plain(at[1] + 1, len(ids) - 1)
    return "assistant", plain(0, len(ids) - 1)


def pieces(conversations: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(conv_id, turn, role, text_order, ids, mask, chars): the output, a row for each turn and one (text_order -1) for each beginning.

    Rows of a conversation are ordered by turn (null last), role and the text's SHA-256; a null role or text is empty; a null conv_id is one
    conversation. Extra columns are not read. ``role`` and ``text_order`` (the text's
    SHA-256) only order rows that share a turn.
    """
    conv_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [encode_turn(role, text, enc) for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                ids, mask, n = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([x.tolist() for x in mask], pa.list_(pa.int8())), pa.array(n, pa.int64())], ["conv_id", "turn", "role", "text_order", "ids", "mask", "chars"])

    clean = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_order", F.sha2("text", 256))
    turns = clean.mapInArrow(run, f"conv_id {conv_type}, turn long, role string, text_order string, ids array<int>, mask array<tinyint>, chars long")
    begin = conversations.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text_order"), F.array(F.lit(IDS["<s>"])).alias("ids"), F.array(F.lit(0).cast("tinyint")).alias("mask"), F.lit(len("<s>")).cast("long").alias("chars"))
    return turns.unionByName(begin)


def _ordered(rows: DataFrame) -> DataFrame:
    first = F.col("text_order").isNotNull()
    return rows.withColumn("_turns", first).repartition("conv_id").sortWithinPartitions("conv_id", "_turns", F.col("turn").asc_nulls_last(), "role", "text_order").drop("_turns")


def digests(output: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from the ids and masks of ``output``.

    A digest takes a conversation's texts in order, so one task reads all its rows, one after another, and holds one of them.
    """
    conv_type = output.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        now, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa_type), pa.array([state[0]], pa.int64()), pa.array([state[1].hexdigest()]), pa.array([state[2]], pa.int64()), pa.array([state[3].hexdigest()]), pa.array([state[4]], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            pa_type = batch.column(0).type
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        yield row()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.asarray(batch.column(4)[i].values), np.asarray(batch.column(5)[i].values)
                state[4] += batch.column(6)[i].as_py()
                if len(ids) == 1 and ids[0] == IDS["<s>"]:
                    continue
                role, text = decode_turn(ids, enc)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                under = unescape(enc.decode_bytes(ids[mask > 0].tolist()).decode())
                state[2] += len(under)
                state[3].update(under.encode())
        if state is not None:
            yield row()

    return _ordered(output).mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def assemble(output: DataFrame) -> DataFrame:
    """(conv_id, ids, mask) with a conversation in a row; for conversations that fit one."""
    own = F.struct(F.col("text_order").isNotNull().alias("turns"), F.col("turn").isNull().alias("none"), "turn", "role", "text_order", "ids", "mask")
    rows = output.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    return rows.select("conv_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("p", lambda x: x["mask"])).alias("mask"))


def render(ids: list[int], folder: str = TOKENIZERS) -> str:
    """The string of a conversation's ids."""
    enc, names, out, held = encoding(folder), {v: k for k, v in IDS.items()}, [], []
    for i in [*ids, RESERVED - 1]:
        if i in names or i == RESERVED - 1:
            out.append(enc.decode_bytes(held).decode())
            out.append(names.get(i, ""))
            held = []
        else:
            held.append(i)
    return "".join(out)
