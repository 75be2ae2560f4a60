"""Cleaning whole texts in Arrow batches: each distinct token is cleaned once as long as it is remembered."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import STOP_WORDS

#: Texts that are cleaned at once, and cleaned tokens that a worker remembers.
ROWS, REMEMBERED = 256, 100_000
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_MENTION, _ODD, _OUTER = re.compile("[^@a-zA-Z0-9]"), re.compile("[^ -~]"), re.compile("^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$")


def clean_token(t: str, stop_words: frozenset[str]) -> str | None:
    """One token as functions.text.clean_tokens() has it without hashtags; None if it goes."""
    if not t or t.startswith("http"):
        return None
    if "@" in t:
        return _MENTION.sub("", t)
    if _ODD.search(t):
        return None
    bare = _OUTER.sub("", t.replace("&lt;", "<").replace("&gt;", ">"))
    return bare if len(bare) >= 2 and bare not in stop_words else None


def cleaned(df: DataFrame, stop_words: list[str] | tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """df (..., text) with `tokens` in place of text, the same as functions.text.clean_tokens(); null of null."""
    keep = [f for f in df.schema.fields if f.name != "text"]
    schema = T.StructType([*keep, T.StructField("tokens", T.ArrayType(T.StringType()))])
    kind, stop = to_arrow_schema(schema), frozenset(stop_words)

    def run(batches):
        known: dict[str, str | None] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                out, ends, at = [], [], 0
                for text in batch.column(len(keep)).slice(lo, ROWS).to_pylist():
                    for t in _SPACE.split(text or ""):
                        if t in known:
                            c = known[t]
                        else:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            c = known[t] = clean_token(t, stop)
                        if c is not None:
                            out.append(c)
                    ends.append(None if text is None else at)
                    at = len(out)
                offsets = pa.array([*ends, at], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(out, pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, ROWS) for i in range(len(keep))), lists], schema=kind)

    return df.select(*(f.name for f in keep), "text").mapInArrow(run, schema)
