"""Encode a corpus with a public tokenizer and decode it again."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Folder of the public vocabularies, on the driver; executors get the files with the job.
FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
#: Code points encoded in one call, which bounds what the library holds at once; one longer text is a call of its own.
CALL_CHARS = 500_000


def _sent(spark: SparkSession, path: str) -> str:
    """Send a vocabulary (and its ranks, where they are there) along with the job, so that executors need not have the folder."""
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        for each in (path, _ranks_of(path)):
            if os.path.exists(each):
                context.addFile(each)
    return path


def _ranks_of(path: str) -> str:
    return path.removesuffix(".json") + ".tiktoken"


def _here(path: str) -> str:
    """Where a worker finds a vocabulary: in its folder, or among the files that came with the job."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a worker; Spark runs the workers side by side
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(_here(path))
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[bytes | None, ...]:
    """Bytes of each id: byte-level vocabularies write every byte as one printable character."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(_here(path), encoding="utf-8") as f:
        spec = json.load(f)
    vocab = dict(spec["model"]["vocab"])
    table: list[bytes | None] = [None] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
    for piece, i in vocab.items():
        table[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    for token in spec.get("added_tokens", []):
        table[token["id"]] = token["content"].encode()
    return tuple(table)


def _calls(texts: list[str]) -> Iterator[list[str]]:
    call, size = [], 0
    for text in texts:
        if call and size + len(text) > CALL_CHARS:
            yield call
            call, size = [], 0
        call.append(text)
        size += len(text)
    if call:
        yield call


def _lists(rows: list[np.ndarray], kind: pa.DataType = pa.int32()) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", spans: bool = False, tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """Replace the ``text`` column by its token ids, without special tokens; their strings in a text are ordinary text.

    With ``spans`` also ``starts`` and ``ends``, the code points at which each token begins and ends; tokens that hold
    only some bytes of a character have the whole character's place. Null and empty texts both give empty arrays; blank ones are text. Texts are
    taken whole. A column that already has a new name is replaced.
    """
    added = [ids, *(["starts", "ends"] if spans else [])]
    df = df.drop(*added)
    rest = [f for f in df.schema.fields if f.name != text]
    path = _sent(df.sparkSession, f"{folder}/{tokenizer}.json")
    schema = T.StructType(rest + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(path)
        encoder = model.encode_batch if spans else model.encode_batch_fast
        for batch in batches:
            found, starts, ends = [], [], []
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for call in _calls(texts):
                for encoding in encoder(call, add_special_tokens=False):
                    found.append(np.array(encoding.ids, np.int32))
                    if spans:
                        place = np.array(encoding.offsets, np.int32).reshape(-1, 2)
                        starts.append(place[:, 0])
                        ends.append(place[:, 1])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            columns += [_lists(x) for x in ((found, starts, ends) if spans else (found,))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


# Fixed value: how byte-level vocabularies cut a text into the pieces that are merged, if they come as ranks.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _sizes(texts: list[str], path: str) -> list[int]:
    """Numbers of tokens. Where the vocabulary is there as ranks too, the library for these counts, which gives the same tokens for less; a text that it cannot take is counted by the other."""
    ranks = _here(_ranks_of(path))
    if not os.path.exists(ranks):
        return [len(e) for call in _calls(texts) for e in _tokenizer(path).encode_batch_fast(call, add_special_tokens=False)]
    encode, sizes = _ranked(ranks).encode_ordinary, []
    for text in texts:
        try:
            sizes.append(len(encode(text)))
        except BaseException as error:  # a panic of the library is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            sizes.append(len(_tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0]))
    return sizes


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """Replace the ``text`` column by its number of tokens (0 for null and empty); only the number leaves Python."""
    df = df.drop(tokens)
    rest = [f for f in df.schema.fields if f.name != text]
    path = _sent(df.sparkSession, f"{folder}/{tokenizer}.json")
    schema = T.StructType([*rest, T.StructField(tokens, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _sizes([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], path)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """Replace the ``ids`` column by the text it stands for.

    Whole encodings come back exactly. A slice that begins or ends inside a character gives U+FFFD for its rest. Null gives null, an
    empty array the empty text, an id outside the vocabulary raises.
    """
    df = df.drop(text)
    rest = [f for f in df.schema.fields if f.name != ids]
    path = _sent(df.sparkSession, f"{folder}/{tokenizer}.json")
    schema = T.StructType([*rest, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if r is None else b"".join(table[i] for i in r).decode("utf-8", "replace") for r in rows]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
