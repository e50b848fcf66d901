"""Byte-level BPE by the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from corvane.llm.common import fresh, lean, table

#: Code points encoded at a time, and the part of a text that is searched for a boundary before a piece is let grow; white
#: space beyond which a run isn't left to the regular expression, whose stack it would overflow.
PIECE, RUN = 1 << 16, 1 << 10
#: The characters of the pattern's white space.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A place where every match of the pattern ends: after anything else, before white space. No alternative of the pattern
#: runs from other characters into white space, and none looks behind, so both sides split as they do in the whole.
_SAFE = regex.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")
_LONG = regex.compile(rf"[{_SPACE}]{{{RUN},}}+")


#: Bytes of the largest rank file that is sent to the executors.
LARGEST = 1 << 26


@functools.lru_cache(maxsize=4)
def encoding_of(raw: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's bytes, without special tokens; made once a process."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ranks(path: str) -> bytes:
    """The bytes of a rank file on the driver's machine: executors get these, so the path needn't exist there."""
    with open(path, "rb") as file:
        raw = file.read(LARGEST + 1)
    if len(raw) > LARGEST:
        raise ValueError(f"{path}: a rank file of over {LARGEST} bytes isn't broadcast")
    return raw


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return encoding_of(ranks(path), pattern)


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """Cuts a long text at safe boundaries; a stretch without any stays whole. The flag tells a piece that is one match.

    White space is one match up to its last character, which goes with what follows, or whole at the text's end. So a long
    run of it is cut off by that rule instead of by the regular expression.
    """
    at = 0
    for run in _LONG.finditer(text):
        yield from _cut(text, at, run.start(), size)
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from _cut(text, at, len(text), size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    while end - at > size:
        found = _SAFE.search(text, at + size, end)
        if not found:
            break
        yield text[at : found.start()], False
        at = found.start()
    if at < end:
        yield text[at:end], False


def encode(enc: tiktoken.Encoding, text: str | None) -> Iterator[list[int]]:
    """Token ids of a text, piece by piece; none for null or empty."""
    for part, whole in pieces(text or ""):
        yield enc._encode_single_piece(part.encode()) if whole else enc.encode_ordinary(part)


def digests(enc: tiktoken.Encoding, text: str | None, spelled: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids as decimals joined by a space, SHA-256 of the decoded bytes."""
    ids_hash, bytes_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in encode(enc, text):
        if n:
            ids_hash.update(b" ")
        ids_hash.update(b" ".join([spelled[i] for i in ids]) if spelled else " ".join(map(str, ids)).encode())
        bytes_hash.update(enc.decode_bytes(ids))
        n += len(ids)
    return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


def _mapped(docs: DataFrame, text: str, extra: dict[str, str], path: str, pattern: str, of: Callable, keep: bool = True) -> DataFrame:
    """``docs`` with the columns ``extra`` (name, type), whose arrays ``of(encoding, texts)`` gives a batch at a time.

    keep: with the column ``text``.
    """
    names = fresh(docs, *extra)
    held = [f for f in docs.schema.fields if keep or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), *(f"`{k}` {v}" for k, v in zip(names, extra.values(), strict=True))])
    places = [i for i, f in enumerate(docs.schema.fields) if keep or f.name != text]
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(sent.value, pattern)
        for batch in batches:
            added = of(enc, batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *added], names=[*(f.name for f in held), *names])

    return docs.mapInArrow(run, schema)


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds ``into``: array<int> of the text's token ids.

    Null and empty texts give an empty array. Rows are encoded alone, so repeated rows get equal ids and an empty table
    stays empty; other columns pass through. Special tokens' strings are ordinary text.
    """

    def of(enc, texts):
        return [pa.array([[i for ids in encode(enc, t.as_py()) for i in ids] for t in texts], pa.list_(pa.int32()))]

    return _mapped(docs, text, {into: "array<int>"}, path, pattern, of)


def packed(ids: list[int], vocabulary: int) -> bytes:
    """Token ids in a row, little-endian: two bytes each where the vocabulary has at most 65,536, else four."""
    return np.array(ids, "<u2" if vocabulary <= 1 << 16 else "<u4").tobytes()


def unpacked(raw: bytes, vocabulary: int) -> list[int]:
    return np.frombuffer(raw, "<u2" if vocabulary <= 1 << 16 else "<u4").tolist()


def sequences(docs: DataFrame, path: str, pattern: str, max_length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk, start (tokens before it), n_tokens, ids: a text's tokens in sequences of at most ``max_length``.

    ids are packed (see packed), as they are moved and stored several times.

    None is lost: a text of more tokens gives several sequences. Null and empty texts give one without tokens. Texts are
    encoded piece by piece and rows leave as they fill, so memory doesn't grow with a text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks(path))
    names = ["doc_id", "chunk", "start", "n_tokens", "ids"]

    def cut(enc: tiktoken.Encoding, value: str | None) -> Iterator[list[int]]:
        held: list[int] = []
        for found in encode(enc, value):
            held += found
            full = len(held) - len(held) % max_length
            full -= max_length * (full == len(held))  # what may be the last waits
            for k in range(0, full, max_length):
                yield held[k : k + max_length]
            del held[: max(full, 0)]
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(sent.value, pattern)
        for batch in batches:
            of, chunks, ids, n = [], [], [], 0

            def rows() -> pa.RecordBatch:
                sizes = pa.array([len(x) for x in ids], pa.int64())  # noqa: B023
                starts = pa.array([c * max_length for c in chunks], pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(chunks, pa.int32()), starts, sizes, pa.array([packed(x, enc.n_vocab) for x in ids], pa.binary())], names=names)  # noqa: B023

            for k, t in enumerate(batch.column(1)):
                for c, part in enumerate(cut(enc, t.as_py())):
                    of.append(k)
                    chunks.append(c)
                    ids.append(part)
                    n += len(part)
                    if n >= 1 << 18:
                        yield rows()
                        of, chunks, ids, n = [], [], [], 0
            if of:
                yield rows()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(lean(run), f"doc_id {kind}, chunk int, start bigint, n_tokens bigint, ids binary")


def decode_column(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the raw bytes of an array of ids (ids needn't end at a character). A null array gives no bytes."""

    def of(enc, values):
        return [pa.array([enc.decode_bytes(v.as_py() or []) for v in values], pa.binary())]

    return _mapped(docs, ids, {into: "binary"}, path, pattern, of)


def digest_column(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, encoding and decoding piece by piece in bounded memory.

    Null and empty texts have no tokens and the digests of nothing.
    """

    def of(enc, texts):
        spelled = _spelled(enc.n_vocab)
        found = [digests(enc, t.as_py(), spelled) for t in texts]
        kinds = (pa.int64(), pa.string(), pa.string())
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]

    return _mapped(docs, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, path, pattern, of, keep)


@functools.lru_cache(maxsize=2)
def _spelled(n: int) -> list[bytes]:
    return [str(i).encode() for i in range(n)]


def query(spark, sf_dir):
    """op4: one row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
