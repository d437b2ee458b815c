"""Byte-level BPE with the ``tokenizers`` library, from a vocabulary given as ranks.

A vocabulary file has a line per token: its bytes in base 64 and its rank, which is its id.
``tokenizers`` works on characters, so each byte has a character of its own (`BYTE_CHARACTERS`), and a
token is the characters of its bytes. Ranks say that of all neighbours whose bytes together
are a token, those of the lowest rank are joined first. Merges are pairs, so every split of a
token into two tokens is a merge, in the order of the ranks; a piece that is a token as it
stands is that token.

Ids alone give back the text: their bytes one after the other. A token may hold a part of a
character. Its offsets, in characters, then are those of the whole character, and only the
bytes of all tokens together are decoded, never those of a single one.

A text is encoded by units, which end at single spaces: a piece always starts there, so the
ids of a text are those of its units. Units repeat; a worker keeps the ids of those it met.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqwatch.llm import kernels

BATCH_TEXTS = 256
#: Units that a worker remembers before it starts anew.
REMEMBERED = 1 << 19
JOINED = 1024
#: At a single space between two other characters a new piece of `public_tokenizers.PATTERN` starts.
UNITS = re.compile(r"(?<=\S) (?=\S)")
NO_UNITS = re.compile(r" \s|\s |^ | \Z")


def byte_characters() -> list[str]:
    """A visible character for each byte: its own in Latin-1 if it has one, else one from 256 on."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if own[b] else chr(256 + own[:b].count(False)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        lines = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in lines}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer, the bytes of each id (none: no token), their numbers, and units met."""

    tokenizer: object
    tokens: list[bytes]
    sizes: np.ndarray
    known: dict[str, bytes]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file, once per Python worker."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    of = ranks(path)

    def name(token: bytes) -> str:
        return "".join(BYTE_CHARACTERS[b] for b in token)

    names = {token: name(token) for token in of}
    merges = [
        (names[token[:k]], names[token[k:]])
        for token in sorted(of, key=of.get)
        for k in range(1, len(token))
        if token[:k] in of and token[k:] in of
    ]
    model = models.BPE({names[token]: rank for token, rank in of.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokens = [b""] * (max(of.values()) + 1)
    for token, rank in of.items():
        tokens[rank] = token
    return Vocabulary(tokenizer, tokens, np.array([len(token) for token in tokens], dtype=np.int64), {})


def units(text: str) -> list[str]:
    """A text cut before single spaces."""
    found = UNITS.split(text) if NO_UNITS.search(text) else text.split(" ")
    return [found[0], *(" " + unit for unit in found[1:])]


def _ids_of_units(new: list[str], own: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """Units and their ids. Units that a text may go on with are encoded many in one string,
    of whose tokens each unit has those of its bytes."""
    follow, alone = [], []
    for unit in new:
        joins = len(unit) > 1 and unit[0] == " " and not unit[1].isspace() and not unit[-1].isspace()
        (follow if joins else alone).append(unit)
    for unit, encoding in zip(alone, own.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
        yield unit, array("i", encoding.ids).tobytes()
    for first in range(0, len(follow), JOINED):
        joined = follow[first : first + JOINED]
        ids = np.array(own.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, dtype=np.int32)
        ends = np.cumsum([len(unit.encode()) for unit in joined])
        cuts = np.searchsorted(np.cumsum(own.sizes[ids]), ends, "right") * ids.itemsize
        data, at = ids.tobytes(), 0
        for unit, cut in zip(joined, cuts.tolist()):
            yield unit, data[at:cut]
            at = cut


def encoded(texts: list[str], own: Vocabulary) -> list[np.ndarray]:
    """The ids of each text."""
    of_texts, known = [units(text) for text in texts], own.known
    if len(known) > REMEMBERED:
        known.clear()
    known.update(_ids_of_units(list(set(chain.from_iterable(of_texts)).difference(known)), own))
    return [np.frombuffer(b"".join(map(known.__getitem__, own_units)), np.int32) for own_units in of_texts]


def token_bytes(ids: np.ndarray, own: Vocabulary) -> bytes:
    """The bytes of the tokens, one after the other. Ids that no token has fail."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(own.tokens) or not own.sizes[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    return b"".join(map(own.tokens.__getitem__, ids.tolist()))


def character_offsets(ids: np.ndarray, own: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters; a token with a part of a character has all of it."""
    within = (np.frombuffer(token_bytes(ids, own), dtype=np.uint8) & 0xC0) == 0x80  # not a character's first byte
    first = np.concatenate([[0], np.cumsum(~within)])  # characters begun before a byte
    ends = np.cumsum(own.sizes[ids])
    starts = ends - own.sizes[ids]
    return (first[starts] - within[starts]).astype(np.int32), first[ends].astype(np.int32)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id, ids`` and, if asked for, ``starts, ends`` in characters.

    ``path`` is a file of ranks that all executors have, ``pattern`` parts texts into pieces. Null is
    an empty text, which has no ids. Rows that repeat a doc_id are rows of their own; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            for first, end, _, _ in kernels.blocks(batch):
                part = batch.slice(first, end - first)
                ids = encoded([t or "" for t in part.column("text").to_pylist()], own)
                columns = [part.column("doc_id"), int_lists(ids)]
                if offsets:
                    columns += [int_lists(x) for x in zip(*(character_offsets(i, own) for i in ids))]
                yield pa.record_batch(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])

    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def int_lists(values: list[np.ndarray] | tuple[np.ndarray, ...]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values).astype(np.int32)))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``doc_id, ids``: ``doc_id, ids, n_tokens, bytes, text``.

    ``text`` has a replacement character where the bytes are no UTF-8, as at the border of ids
    that were cut out of a longer list. Null and no ids are an empty text; an id that the
    vocabulary lacks fails. Rows that repeat a doc_id are rows of their own; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        names = ["doc_id", "ids", "n_tokens", "bytes"]
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for first in range(0, batch.num_rows, BATCH_TEXTS):
                rows = range(first, min(first + BATCH_TEXTS, batch.num_rows))
                found = pa.array([token_bytes(flat[bounds[i] : bounds[i + 1]], own) for i in rows], pa.binary())
                part = batch.slice(first, len(found))
                counts = pa.array(sizes[first : first + len(found)], pa.int64())
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), counts, found], names=names)

    rows = tokens.select(F.col("doc_id").cast("long"), "ids")
    decoded = rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, bytes binary")
    return decoded.withColumn("text", F.make_valid_utf8(F.col("bytes").cast("string")))
