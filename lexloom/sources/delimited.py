"""Streams of length-delimited protobuf messages: annotated articles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .schemas import ARTICLE

# The field numbers of the messages. A nested dict is a message; lists are repeated fields.
TOKEN = {1: ("word", str), 2: ("pos", str), 7: ("originalText", str), 8: ("ner", str), 10: ("lemma", str)}
SENTENCE = {1: ("token", [TOKEN])}
DOCUMENT = {1: ("text", str), 2: ("sentence", [SENTENCE])}
QUESTION = {1: ("id", str), 2: ("question", DOCUMENT), 3: ("answers", [DOCUMENT]), 4: ("answerOffsets", [int])}
PARAGRAPH = {1: ("context", DOCUMENT), 2: ("qas", [QUESTION])}
ARTICLE_FIELDS = {1: ("title", str), 2: ("paragraphs", [PARAGRAPH])}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        size, at = varint(data, at)
        if at + size > len(data):
            raise ValueError("the stream ends inside a message")
        yield data[at : at + size]
        at += size


def decode(data: bytes, fields: dict) -> dict:
    """A message as a dict of the listed fields; others are skipped."""
    out = {name: [] if isinstance(kind, list) else None for name, kind in fields.values()}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire, number = tag & 7, tag >> 3
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if number not in fields:
            continue
        name, kind = fields[number]
        of = kind[0] if isinstance(kind, list) else kind
        if of is int and isinstance(value, bytes):  # packed
            packed, i = [], 0
            while i < len(value):
                one, i = varint(value, i)
                packed.append(_signed(one))
            out[name] += packed
            continue
        value = value.decode("utf-8") if of is str else _signed(value) if of is int else decode(value, of)
        if isinstance(kind, list):
            out[name].append(value)
        else:
            out[name] = value
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _varint_bytes(value: int) -> bytes:
    out, value = bytearray(), value & (1 << 64) - 1
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode(message: dict, fields: dict) -> bytes:
    out = b""
    for number, (name, kind) in fields.items():
        values = message.get(name)
        for value in values or [] if isinstance(kind, list) else [] if values is None else [values]:
            of = kind[0] if isinstance(kind, list) else kind
            if of is int:
                out += _varint_bytes(number << 3) + _varint_bytes(value)
            else:
                body = value.encode() if of is str else encode(value, of)
                out += _varint_bytes(number << 3 | 2) + _varint_bytes(len(body)) + body
    return out


def _joined(parts: list, n: int) -> pa.Array:
    """Strings of bytes side by side."""
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary())) if parts else pa.array([b""] * n, pa.binary())


def _headed(body: pa.Array, head: bytes) -> pa.Array:
    """Bodies with a head and their length before them; nulls become empty."""
    size, at = np.unique(pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False), return_inverse=True)
    before = pa.array([head + _varint_bytes(int(k)) for k in size], pa.binary()).take(pa.array(at.reshape(-1)))
    return pc.fill_null(pc.binary_join_element_wise(before, body, pa.scalar(b"", pa.binary())), b"")


def _fields_of(values: pa.Array, number: int, of) -> pa.Array:
    """A field of this number for each value; empty for a null."""
    if pa.types.is_null(values.type):
        return pa.array([b""] * len(values), pa.binary())
    if of is int:
        size, at = np.unique(pc.fill_null(values, 0).to_numpy(zero_copy_only=False), return_inverse=True)
        coded = pa.array([_varint_bytes(number << 3) + _varint_bytes(int(k)) for k in size], pa.binary()).take(pa.array(at.reshape(-1)))
        return pc.if_else(values.is_valid(), coded, pa.scalar(b"", pa.binary()))
    return _headed(values.cast(pa.binary()) if of is str else encode_all(values, of), _varint_bytes(number << 3 | 2))


def encode_all(messages: pa.StructArray, fields: dict) -> pa.Array:
    """encode() of an array of messages, a field of all of them at a time; a null stays null."""
    parts = []
    for number, (name, kind) in fields.items():
        if messages.type.get_field_index(name) < 0:
            continue
        values = pc.struct_field(messages, name)
        if isinstance(kind, list):
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            values = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), _fields_of(values.flatten(), number, kind[0])), pa.scalar(b"", pa.binary()))
        else:
            values = _fields_of(values, number, kind)
        parts.append(values)
    return pc.if_else(messages.is_valid(), _joined(parts, len(messages)), pa.scalar(None, pa.binary()))


def _parsed(data: bytes, fields: dict, out: dict[int, list]) -> None:
    """Appends the raw values of the listed fields of a message."""
    at, end = 0, len(data)
    while at < end:
        tag = data[at]
        at += 1
        if tag >= 0x80:
            tag, at = varint(data, at - 1)
        wire = tag & 7
        if wire == 2:
            size = data[at]
            at += 1
            if size >= 0x80:
                size, at = varint(data, at - 1)
            if (own := out.get(tag >> 3)) is not None:
                own.append(data[at : at + size])
            at += size
        elif wire == 0:
            value, at = varint(data, at)
            if (own := out.get(tag >> 3)) is not None:
                own.append(value)
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
        else:
            raise ValueError(f"wire type {wire}")


def _ints(values: list) -> list[int]:
    """Integers, single ones and packed ones."""
    out = []
    for value in values:
        at = 0
        if isinstance(value, int):
            out.append(_signed(value))
            continue
        while at < len(value):
            one, at = varint(value, at)
            out.append(_signed(one))
    return out


def decode_all(messages: list[bytes | None], fields: dict, kind: pa.StructType) -> pa.StructArray:
    """decode() of messages as an array of a type with some or all of their fields; null for None. Equal messages that have only strings are decoded once."""
    if kind.num_fields and all(of is str for _, of in fields.values()) and len(messages) > 1:
        number: dict = {}
        at = [number.setdefault(m, len(number)) for m in messages]
        if len(number) < len(messages):
            return decode_all(list(number), fields, kind).take(pa.array(at, pa.int32()))
    wanted = {n: (name, of) for n, (name, of) in fields.items() if kind.get_field_index(name) >= 0}
    values, ends = {n: [] for n in wanted}, {n: [0] for n in wanted}
    for message in messages:
        _parsed(message or b"", fields, values)
        for n, (_, of) in wanted.items():
            if not isinstance(of, list):  # the last one counts
                del values[n][ends[n][-1] : -1]
            elif of[0] is int:
                values[n][ends[n][-1] :] = _ints(values[n][ends[n][-1] :])
            ends[n].append(len(values[n]))
    columns = {}
    for n, (name, of) in wanted.items():
        own, at = kind.field(name).type, np.array(ends[n], np.int32)
        one, inner = (of[0], own.value_type) if isinstance(of, list) else (of, own)
        if one is int:
            flat = pa.array(values[n] if isinstance(of, list) else _ints(values[n]), inner)
        else:
            flat = pa.array(values[n], pa.binary()).cast(inner) if one is str else decode_all(values[n], one, inner)
        if isinstance(of, list):
            columns[name] = pa.ListArray.from_arrays(pa.array(at), flat).cast(own)
        else:
            columns[name] = flat.take(pa.array(at[:-1], mask=at[1:] == at[:-1]))
    listed = [columns.get(f.name, pa.nulls(len(messages), f.type)) for f in kind]
    return pa.StructArray.from_arrays(listed, fields=list(kind), mask=pa.array([m is None for m in messages], pa.bool_()))


def write_frames(messages: list[dict], fields: dict = ARTICLE_FIELDS) -> bytes:
    return b"".join(_varint_bytes(len(body)) + body for body in (encode(m, fields) for m in messages))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a file or folder of streams, a row each. A stream has no marks to split it at, so that a file is a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                for frame in frames(content):
                    yield pd.DataFrame([decode(frame, ARTICLE_FIELDS)])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ARTICLE)
