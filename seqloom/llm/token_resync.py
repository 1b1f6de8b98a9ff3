"""Token counts of texts of any length by overlap resynchronisation.

A text above ``chunk`` characters is encoded in overlapping chunks with offsets. The pieces are spliced at a position
that is proven to be a boundary of the whole text's encoding, so the counts equal those of one call over the whole
text, while memory stays bounded by the chunk.

Why a splice is exact. The vocabulary's pre-tokeniser scans from left to right without memory: what it cuts after a
position depends on the text after it only, and it looks one character past a match. Merges never cross a cut. The
left chunk starts at a proven cut, so its cuts are those of the whole text up to ``margin`` characters before its end
(``margin`` exceeds the lookahead and the longest special string, which might be halved by the chunk's end). If the
right chunk, started anywhere in the overlap, also has a cut at such a position, both scans go on alike from there.
Only ends of words that close with a character other than space are used, as offsets are trimmed of spaces. If there
is no common cut, the overlap is doubled and the left chunk encoded anew, up to the whole rest of the text.

Null texts count 0 bytes and 0 tokens, as do empty ones. Rows are kept one by one: repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once per process and kept to one thread."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def margin_of(tok) -> int:
    return 4 + max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)


def _cuts(text: str, enc, start: int) -> dict[int, int]:
    """Position in the text -> tokens up to it, for the ends of words that close with a non-space character."""
    ids, spans = enc.word_ids, enc.offsets
    out = {}
    for k, (_, end) in enumerate(spans):
        last = k + 1 == len(spans) or ids[k + 1] != ids[k] or ids[k] is None
        if last and end and not text[start + end - 1].isspace():
            out[start + end] = k + 1
    return out


def spliced_ids(tok, text: str, chunk: int, overlap: int) -> Iterator[list[int]]:
    """The token ids of ``text``, in runs; together they equal the ids of one call over all of it."""
    margin = margin_of(tok)
    at, n = 0, len(text)
    while n - at > chunk:
        size, lap, cut = chunk, overlap, None
        while cut is None and at + size < n:
            end = at + size
            left = tok.encode(text[at:end], add_special_tokens=False)
            right = tok.encode(text[end - lap : end], add_special_tokens=False)
            proven = _cuts(text, left, at)
            # the last common cut, as it leaves the least to encode twice
            common = [p for p in _cuts(text, right, end - lap) if p in proven and at < p <= end - margin]
            if common:
                cut = max(common)
            else:
                lap, size = 2 * lap, size + 2 * lap
        if cut is None:
            break
        yield left.ids[: proven[cut]]
        at = cut
    yield tok.encode(text[at:], add_special_tokens=False).ids


def count_tokens(tok, texts: list[str], chunk: int, overlap: int) -> list[int]:
    out = [0] * len(texts)
    short = [k for k, t in enumerate(texts) if len(t) <= chunk]
    for k, e in zip(short, tok.encode_batch_fast([texts[k] for k in short], add_special_tokens=False)):
        out[k] = len(e.ids)
    for k, t in enumerate(texts):
        if len(t) > chunk:
            out[k] = sum(map(len, spliced_ids(tok, t, chunk, overlap)))
    return out


def token_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = 16_384, overlap: int = 512, batch: int = 32
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` for each row; ``path`` must exist on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = count_tokens(tok, texts, chunk, overlap)
                sizes = [len(t.encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [key, "n_bytes", "n_tokens"]
                )

    rows = docs.select(F.col(key), F.col(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
