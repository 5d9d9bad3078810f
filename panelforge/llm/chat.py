"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered as one string and encoded once, with offsets.  The spans of the assistant's
texts and the spans of the tokens are both sorted, so binary search finds the tokens under each text.

Template, by role: system `<s><<SYS>>text<</SYS>>`, user `<s>[INST]text[/INST]`, assistant `<s>text</s>`, any
other role `<s>[ROLE]role[/ROLE]text</s>`.  A control string inside a text gets a backslash after its first
character (one more if it has some there already), which unescape() takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What follows the first character of a control string.
CONTROL = r"/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]"
_ESCAPE = re.compile(rf"([<\[])(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
_TURN = re.compile(r"<s>(?:<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "system":
            head, tail = "<s><<SYS>>", "<</SYS>>"
        elif role == "user":
            head, tail = "<s>[INST]", "[/INST]"
        elif role == "assistant":
            head, tail = "<s>", "</s>"
            spans.append((at + len(head), at + len(head) + len(body)))
        else:
            head, tail = f"<s>[ROLE]{escape(role)}[/ROLE]", "</s>"
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        out.append((role, unescape(m[kind])))
    return out


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the tokens that meet a span, and the characters under it as sorted pieces (start, end, span).

    Both inputs are sorted by start.  Tokens that share a character, as when a character is cut into
    several tokens, count it once; of a token that reaches over a span's end only the part inside counts.
    """
    mask = np.zeros(len(offsets), bool)
    if not len(spans) or not len(offsets):
        return mask, np.zeros((0, 3), np.int64)
    starts, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    lo = np.searchsorted(ends, spans[:, 0], "right")
    hi = np.searchsorted(starts, spans[:, 1], "left")
    found = []
    for k, (a, b) in enumerate(zip(lo, hi, strict=True)):
        if a >= b or spans[k, 0] == spans[k, 1]:
            continue
        mask[a:b] = offsets[a:b, 1] > offsets[a:b, 0]
        s = np.maximum(starts[a:b], spans[k, 0])
        e = np.minimum(ends[a:b], spans[k, 1])
        s = np.maximum(s, np.concatenate([[0], e[:-1]]))
        ok = e > s
        found.append(np.stack([s[ok], e[ok], np.full(int(ok.sum()), k)], 1))
    return mask, np.concatenate(found) if found else np.zeros((0, 3), np.int64)


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(spec: str):
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[key] = t
    return _TOKENIZERS[key]


def format_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, ids, loss_mask and the pieces under the mask.

    Turns are ordered by turn, role and text (nulls first), repeated rows stay.  A null role or text is empty;
    a null conv_id is a conversation of its own; extra columns are left out; no rows give no rows.  A
    conversation is one record and so is held whole by one task, whatever its length.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    # the text itself stays out of the shuffle's sort: only conversations are put together
    whole = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [render(list(zip(r, t, strict=True))) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                rows = []
                for (text, spans), code in zip(made, tokenizer.encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
                    mask, piece = token_mask(np.array(code.offsets, np.int64).reshape(-1, 2), np.array(spans, np.int64).reshape(-1, 2))
                    rows.append((text, code.ids, mask.tolist(), piece.ravel().tolist(), len(spans)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in part.column(1)], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.bool_())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                    ["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_pieces"],
                )

    return whole.mapInArrow(run, "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, loss_pieces array<long>")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations(): turns, text under the mask, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss, parts = [], np.array(flat, np.int64).reshape(-1, 3)
                cut = np.flatnonzero(np.diff(parts[:, 2])) + 1 if len(parts) else []
                for piece in np.split(parts, cut) if len(parts) else []:
                    loss.append(unescape("".join(text[a:b] for a, b, _ in piece.tolist())))
                said, turned = "".join(loss), "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(turned.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_pieces").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
