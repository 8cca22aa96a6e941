"""Encoding of a corpus with a public byte-level tokenizer (problem 7).

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Two neighbouring chunks are stitched at
the first pre-token boundary on which both agree, and the pieces between the stitches are encoded independently. The
pre-tokeniser has no look-behind, and a change from visible text to white space always ends a pre-token, so the pieces'
ids put together are the ids of the whole text. Where no boundary is agreed on (a run longer than the overlap), the
neighbours are joined into one piece instead, so that the result stays exact.

Defined results: null and empty texts get an empty list; repeated ids are rows of their own only if the input has
them so; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrow import int_lists, strings

#: Fixed value: the pre-token pattern that belongs to the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 8192
OVERLAP_CHARS = 512


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file, one for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(path: str, ids: list[int]) -> str:
    """The text of ids: the tokens' raw bytes put together."""
    return b"".join(map(encoder(path).decode_single_token_bytes, ids)).decode("utf-8")


def _boundaries(text: str, low: int, high: int) -> list[int]:
    """Ends of pre-tokens within [low, high) at which visible ASCII is followed by ASCII white space."""
    found = []
    for match in _pattern().finditer(text, max(0, low - 1)):
        end = match.end()
        if end >= high:
            break
        if end > low and "!" <= text[end - 1] <= "~" and text[end] in " \n\r\t":
            found.append(end)
    return found


@functools.lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def _chunks(chunk: int, overlap: int):
    """(doc, text) -> (doc, i, last, text of the chunk with its overlap, agreed boundaries at its two ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), strings(batch.column(1))):
                count = -(-len(text) // chunk)
                for first in range(0, count, 256):
                    at = range(first, min(count, first + 256))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc.as_py()] * len(at), batch.schema.field(0).type),
                            pa.array(list(at), pa.int32()),
                            pa.array([i == count - 1 for i in at], pa.bool_()),
                            pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in at], pa.string()),
                        ],
                        names=["doc", "i", "last", "part"],
                    )

    return run


def _ends(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, parts = batch.column("i").to_pylist(), strings(batch.column("part"))
            head = [np.array(_boundaries(t, 0, min(overlap, len(t))), np.int64) + i * chunk for i, t in zip(numbers, parts)]
            # The tail is read from a boundary before it, so that it doesn't start within a pre-token.
            tail = []
            for i, t in zip(numbers, parts):
                before = max(0, chunk - overlap)
                start = next((m for m in range(chunk, before, -1) if m < len(t) and t[m - 1] > " " and t[m] in " \n\r\t"), before)
                tail.append(np.array([b for b in _boundaries(t, start, len(t)) if b > chunk], np.int64) + i * chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, int_lists(head, pa.int64()), int_lists(tail, pa.int64())], names=[*batch.schema.names, "head", "tail"])

    return run


def pieces(docs: DataFrame, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc, piece, part) of docs(doc, text): texts cut where overlapping chunks agree on a pre-token boundary."""
    kind = docs.schema["doc"].dataType.simpleString()
    chunks = docs.mapInArrow(_chunks(chunk, overlap), f"doc {kind}, i int, last boolean, part string").repartition("doc", "i")
    ends = chunks.mapInArrow(_ends(chunk, overlap), f"doc {kind}, i int, last boolean, part string, head array<bigint>, tail array<bigint>")
    by_doc = Window.partitionBy("doc").orderBy("i")
    ends = ends.withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc)))).drop("head", "tail")
    base = F.col("i").cast("bigint") * chunk
    ends = ends.withColumn("start", F.coalesce(F.lag("cut").over(by_doc), base)).withColumn("end", F.coalesce("cut", F.when(~F.col("last"), base + chunk)))
    ends = ends.withColumn("piece", F.coalesce(F.sum(F.col("cut").isNotNull().cast("bigint")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.expr(f"substring(part, int(start - i * {chunk}L) + 1, int(coalesce(end - start, 2147483647L)))")
    joined = F.array_sort(F.collect_list(F.struct("i", own.alias("own"))))
    return ends.groupBy("doc", "piece").agg(F.concat_ws("", F.transform(joined, lambda x: x["own"])).alias("part"))


def _encode(path: str | None, counts: bool):
    """Batches of (..., text) -> the same columns with ids or their number in place of the text; a worker looks up the vocabulary itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_vocabulary()).encode_ordinary
        for batch in batches:
            texts = strings(batch.column(batch.num_columns - 1))
            if counts:
                last = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            else:
                last = int_lists([np.array(encode(t) if t else [], np.int32) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], "out"])

    return run


def _run(docs: DataFrame, id_column: str, text_column: str, path: str | None, counts: bool, chunk: int, overlap: int) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    kind, out = rows.schema["doc"].dataType.simpleString(), "bigint" if counts else "array<int>"
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    whole = rows.where(~is_long).mapInArrow(_encode(path, counts), f"doc {kind}, out {out}")
    cut = pieces(rows.where(is_long), chunk, overlap).repartition("doc", "piece")
    cut = cut.mapInArrow(_encode(path, counts), f"doc {kind}, piece bigint, out {out}").groupBy("doc")
    if counts:
        cut = cut.agg(F.sum("out").alias("out"))
    else:
        cut = cut.agg(F.array_sort(F.collect_list(F.struct("piece", "out"))).alias("all")).select("doc", F.flatten(F.transform("all", lambda x: x["out"])).alias("out"))
    return whole.unionByName(cut)


def token_ids(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, ids) of every row; ids are unique in ``docs``, null and empty texts get an empty list."""
    return _run(docs, id_column, text_column, path, False, chunk, overlap).select(F.col("doc").alias(id_column), F.col("out").alias("ids"))


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_tokens) of every row by the same encoding."""
    return _run(docs, id_column, text_column, path, True, chunk, overlap).select(F.col("doc").alias(id_column), F.col("out").alias("n_tokens"))
