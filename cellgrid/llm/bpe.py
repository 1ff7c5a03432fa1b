"""Byte-level BPE as a transducer with bounded lookahead, and its inverse."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellgrid.llm.common import built, map_batches, texts, tokenizer_path

# Fixed value: the split that byte-level vocabularies of this kind are made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 1 << 16
CACHED_PIECES = 1 << 17
NEVER = 1 << 30


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge list and token bytes of a vocabulary file; small, and the same for every row.

    ``lookahead`` is the number of bytes that suffices to know a token is final: no later
    byte can change tokens that end that far before the last byte read.  It is the heaviest
    chain of merges ``r1, r2, ...`` in merge order in which the left part of each occurs at the
    left edge of the right part of the next: only along such a chain can a difference behind
    the window move to the left, each time by the bytes of the left part.
    """

    def __init__(self, data: dict) -> None:
        model = data["model"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ids = model["vocab"]
        self.bytes_of = [b""] * (1 + max([*ids.values(), *(t["id"] for t in data["added_tokens"])]))
        for token, number in ids.items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.byte_ids = [ids[c] for c in byte_alphabet()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        left_of: dict[int, int] = {}
        best: dict[int, int] = {}
        self.lookahead = 0
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = ids[left], ids[right], ids[left + right]
            if w in left_of or any(len(x) > 1 and ids[x] not in left_of for x in (left, right)):
                raise ValueError("a merge uses a part that no earlier merge makes, or makes a token again")
            reach, edge = 0, v
            while edge is not None:
                reach = max(reach, best.get(edge, 0))
                edge = left_of.get(edge)
            reach += len(self.bytes_of[u])
            best[u] = max(best.get(u, 0), reach)
            self.lookahead = max(self.lookahead, reach)
            left_of[w] = u
            self.ranks[u << 32 | v] = rank
            self.made.append(w)
        self.longest = max(map(len, self.bytes_of))

    @classmethod
    def read(cls, path: str | None = None) -> Vocabulary:
        with open(path or tokenizer_path(), encoding="utf-8") as file:
            return cls(json.load(file))

    @classmethod
    def of(cls, plain: dict) -> Vocabulary:
        """A vocabulary from its own attributes, as they are broadcast."""
        made = cls.__new__(cls)
        made.__dict__ |= plain
        return made


class Pieces(dict):
    """Packed ids of pieces seen lately: two generations of a bounded number each."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.encoder.piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Encoder:
    """Text to token ids; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = regex.compile(SPLIT).findall
        self.gap = regex.compile(r"\S\s").search
        special = "|".join(map(regex.escape, vocabulary.special)) or r"(?!)"
        self.specials = regex.compile(f"({special})")
        self.window = vocabulary.lookahead + max(512, vocabulary.longest)
        self.pieces = Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """All merges applied in order of rank, the leftmost first."""
        ranks, made = self.vocabulary.ranks, self.vocabulary.made
        byte_ids = self.vocabulary.byte_ids
        ids = [byte_ids[b] for b in data]
        get = ranks.get
        order = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while order:
            rank = min(order)
            if rank == NEVER:
                break
            at = order.index(rank)
            new = made[rank]
            ids[at] = new
            del ids[at + 1], order[at]
            if at:
                order[at - 1] = get(ids[at - 1] << 32 | new, NEVER)
            if at < len(order):
                order[at] = get(new << 32 | ids[at + 1], NEVER)
        return ids

    def piece(self, data: bytes) -> Iterable[int]:
        """The ids of one piece; a long one passes a window that emits only final tokens."""
        if len(data) <= self.window:
            return self.merged(data)
        return self.slide(data)

    def slide(self, data: bytes) -> list[int]:
        sizes, out, at = self.vocabulary.bytes_of, [], 0
        while at < len(data):
            ids = self.merged(data[at : at + self.window])
            if at + self.window >= len(data):
                return out + ids
            end, final = 0, 0
            for final, token in enumerate(ids):
                if end + len(sizes[token]) > self.window - self.vocabulary.lookahead:
                    break
                end += len(sizes[token])
            out += ids[:final]
            at += end
        return out

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids (little-endian, 32 bits) of ``text``, slice by slice.

        A slice ends between a character and the white space after it, where the split
        always has a border.
        """
        for number, part in enumerate(self.specials.split(text)):
            if number % 2:
                yield np.array([self.vocabulary.special[part]], "<u4").tobytes()
                continue
            at = 0
            while at < len(part):
                cut = self.gap(part, at + SLICE) if len(part) > at + SLICE else None
                end = cut.start() + 1 if cut else len(part)
                yield b"".join(map(self.pieces.__getitem__, self.split(part[at:end])))
                at = end


class Decoder:
    """Token ids to text: bytes pass an incremental UTF-8 machine, so a character may span tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_of = vocabulary.bytes_of

    @staticmethod
    def machine() -> codecs.IncrementalDecoder:
        return codecs.getincrementaldecoder("utf-8")("replace")

    def next(self, machine: codecs.IncrementalDecoder, packed: bytes) -> str:
        """The text that more packed ids add."""
        return machine.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def stream(self, packed: bytes) -> Iterator[str]:
        machine = self.machine()
        for at in range(0, len(packed), 4 * SLICE):
            yield self.next(machine, packed[at : at + 4 * SLICE])
        yield machine.decode(b"", True)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of each row; ``ids`` is binary, four little-endian bytes an id.

    The whole text is encoded; strings of special tokens in it become those tokens.  A null
    or empty text has no ids.  Repeated rows and null ids each give their own row; other
    columns are ignored.  Memory per row is the text and its ids; pieces that no split
    shortens pass through a window of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(path)))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        encoder = built(shared, lambda plain: Encoder(Vocabulary.of(plain)))
        ids = [b"".join(encoder.stream(text)) for text in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary", sliced=True)


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its packed ids; bytes that are not UTF-8 become U+FFFD, null ids null."""
    shared = tokens.sparkSession.sparkContext.broadcast({"bytes_of": Vocabulary.read(path).bytes_of})
    position = tokens.columns.index(ids_col)
    names = [c for c in tokens.columns if c != out_col]
    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in names) + f", `{out_col}` string"

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        decoder = built(shared, lambda plain: Decoder(Vocabulary.of(plain)))
        text = [None if x is None else "".join(decoder.stream(x)) for x in batch.column(position).to_pylist()]
        return {**{c: batch.column(c) for c in names}, out_col: text}

    return map_batches(tokens, run, schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of the text they decode to.

    What ``decode`` makes of ``encode``, in one pass: ids and texts do not leave the worker, and
    pass through the digests slice by slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(path)))

    def coders(plain: dict) -> tuple[Encoder, Decoder]:
        vocabulary = Vocabulary.of(plain)
        return Encoder(vocabulary), Decoder(vocabulary)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        encoder, decoder = built(shared, coders)
        counts, ids_digests, text_digests = [], [], []
        for text in batch.column("text").to_pylist():
            ids, said, n = hashlib.sha256(), hashlib.sha256(), 0
            machine = decoder.machine()
            for packed in encoder.stream(text):
                ids.update(packed)
                said.update(decoder.next(machine, packed).encode())
                n += len(packed) // 4
            said.update(machine.decode(b"", True).encode())
            counts.append(n)
            ids_digests.append(ids.hexdigest())
            text_digests.append(said.hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids_digests, "decoded_sha256": text_digests}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(texts(docs, id_col, text_col), run, schema, sliced=True)
