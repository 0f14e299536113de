"""Token counts by overlap resynchronisation.

A huge document is encoded as overlapping chunks of characters. Each chunk yields its tokens with
character offsets; neighbours are spliced at a boundary that both have and that is proven stable: a blank
after a non-blank. Every word pattern of the byte-level vocabulary puts a boundary there whatever stands
before, and what follows depends only on the text from there on, so the spliced ids are those of the whole
text. A chunk reaches as far as it takes to hold such a boundary, so a run without any is encoded once, and
time is linear. An overlap begins before the last boundary of the chunk; where both sides still don't align
there, it is widened.

The result has a row for each document. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are
counted each; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, short, table
from quillstone.llm.vocab import ByteBpe, default_path, loaded

#: Characters of a chunk, and of the overlap it begins with.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256


def _boundaries(enc: ByteBpe, chunk: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk that begins at character `at`, and the character offset at which each begins (-1: inside a character)."""
    ids = enc.ids(chunk)
    starts = np.concatenate([[0], np.cumsum(enc.lengths[ids])[:-1]]) if len(ids) else np.zeros(0, np.int64)
    if chunk.isascii():
        return ids, starts + at
    raw = np.frombuffer(chunk.encode(), np.uint8)
    lead = (raw & 0xC0) != 0x80
    chars = np.cumsum(lead) - 1
    return ids, np.where(lead[starts], chars[starts] + at, -1)


#: A blank after a non-blank; characters that only Python counts as blanks don't qualify.
_STABLE = re.compile(r"(?<=\S)[^\S\x1c-\x1f]")


def last_stable(text: str, begin: int, end: int) -> int | None:
    """The last stable boundary within (begin, end); looks back in growing steps."""
    step, hi = 256, end
    while hi > begin + 1:
        lo = max(begin + 1, hi - step)
        found = [m.start() for m in _STABLE.finditer(text, lo, hi)]
        if found:
            return found[-1]
        hi, step = lo, step * 4
    return None


def reach(text: str, begin: int, size: int) -> int:
    """Where a chunk ends that begins here: after `size` characters, or where that holds no stable boundary just beyond the next one, so that such a run is encoded once."""
    end = begin + size
    if end >= len(text) or last_stable(text, begin, end) is not None:
        return min(end, len(text))
    m = _STABLE.search(text, end)
    return m.start() + 1 if m else len(text)


def spliced_ids(enc: ByteBpe, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> np.ndarray:
    """The ids of a whole text, from overlapping chunks; equal to enc.ids(text)."""
    if len(text) <= chunk_chars + overlap_chars:
        return enc.ids(text)
    out: list[np.ndarray] = []
    begin, end = 0, reach(text, 0, chunk_chars)
    ids, at = _boundaries(enc, text[begin:end], begin)
    while end < len(text):
        s, overlap = last_stable(text, begin, end), overlap_chars
        nxt_end = max(reach(text, s, chunk_chars), min(len(text), end + 1))
        while True:
            nxt = max(begin, s - overlap)
            more, more_at = _boundaries(enc, text[nxt:nxt_end], nxt)
            # s is stable; whatever else both sides have in common is no proof.
            if nxt == begin or ((at == s).any() and (more_at == s).any()):
                break
            overlap *= 4
        p = s if nxt > begin else begin
        out.append(ids[: int(np.argmax(at == p))] if p > begin else ids[:0])
        k = int(np.argmax(more_at == p)) if p > nxt else 0
        ids, at, begin, end = more[k:], more_at[k:], p, nxt_end
    out.append(ids)
    return np.concatenate(out)


def counted(enc: ByteBpe, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    return enc.count(text) if len(text) <= chunk_chars + overlap_chars else len(spliced_ids(enc, text, chunk_chars, overlap_chars))


def n_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """The number of ids of a text column; 0 where it is null."""
    path = vocabulary or default_path("byte_bpe_50k.json")

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = loaded(ByteBpe, path)
        for texts in batches:
            yield pd.Series([counted(enc, t) if t else 0 for t in texts], dtype="int64")

    return run(text)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row; narrow, without a shuffle."""
    bounded(docs.sparkSession)
    path = vocabulary or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = loaded(ByteBpe, path)
        for batch in short(batches):
            n_bytes, n_ids = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_ids.append(counted(enc, text, chunk_chars, overlap_chars))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_ids, pa.int64()), pa.array([n > limit for n in n_ids], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(column(id_col)).schema[0].dataType.simpleString()
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
