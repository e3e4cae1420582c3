"""Byte-level BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the bytes cuts every text into chunks whose borders depend
on nearby content alone, so passages that documents share give equal chunks.
The inside of a chunk is encoded once and looked up afterwards; the joins
between chunks are repaired by encoding the text around them anew, wider and
wider until the new tokens agree with those of both neighbours.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: A border stands where this many bits of the rolling hash are zero: a chunk has 2**10 bytes on average.
BORDER_BITS = 10
#: Bytes of encoded chunks that a Python worker keeps.
CACHE_BYTES = 32 << 20
#: Encoded words beside joins that a Python worker keeps.
WORDS = 100_000


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as itself if printable, else as the next unused code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one tokenizer file; keeps what it has encoded."""

    def __init__(self, content: str, border_bits: int = BORDER_BITS, cache_bytes: int = CACHE_BYTES):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(content)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = byte_of_symbol()
        self.bytes_of: dict[int, bytes] = {i: s.encode() for s, i in special.items()}
        ranks = {}
        for symbols, i in spec["model"]["vocab"].items():
            if symbols not in special:
                ranks[self.bytes_of.setdefault(i, bytes(byte[c] for c in symbols))] = i
        self.digits = {i: str(i) for i in self.bytes_of}
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        # The same merges in the faster library: ids of merged tokens rise in the order of the merges.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.mask = np.uint64((1 << border_bits) - 1)
        self.room, self.cache_bytes = cache_bytes, cache_bytes
        self.cache: dict[bytes, tuple[int, str, bytes]] = {}
        self.words: dict[bytes, list[int]] = {}

    def ids(self, part: bytes) -> list[int]:
        text = part.decode()
        try:
            return self.fast.encode(text, allowed_special="all") if b"<|" in part else self.fast.encode_ordinary(text)
        except BaseException as e:  # its regular expressions give up on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.library.encode(text, add_special_tokens=False).ids

    def shown(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(self.digits.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def borders(self, b: np.ndarray) -> np.ndarray:
        """Where a rolling hash of eight bytes says so, but not within a character."""
        if len(b) < 16:
            return np.empty(0, np.int64)
        h = b.astype(np.uint64)
        for k in (1, 2, 4):
            h = h[:-k] + (h[k:] << np.uint64(8 * k))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(((h >> np.uint64(40)) & self.mask) == 0) + 4
        return at[(b[at] & 0xC0) != 0x80]

    @staticmethod
    def word_starts(b: np.ndarray) -> np.ndarray:
        """Spaces between visible characters of ASCII or of two bytes: a token starts there whatever stands around."""
        seen = (b > 32) & (b < 127)
        wide = (b >= 0xC3) & (b <= 0xDF)  # first bytes of U+00C0 to U+07FF, none of which is white space
        before = seen[:-2].copy()
        before[1:] |= wide[:-3]
        return np.flatnonzero((b[1:-1] == 32) & before & (seen | wide)[2:]) + 1

    def word(self, part: bytes) -> list[int]:
        if (found := self.words.get(part)) is None:
            if len(self.words) > WORDS:
                self.words.clear()
            found = self.words[part] = self.ids(part)
        return found

    def listed(self, data: bytes, cuts: list[int]) -> list[int]:
        return [t for a, z in zip(cuts, cuts[1:]) for t in self.word(data[a:z])]

    def chunk(self, body: bytes) -> tuple[int, str, bytes]:
        """Of the inside of a chunk: encoded once as long as it is kept."""
        if (found := self.cache.get(body)) is None:
            found = self.shown(self.ids(body))
            self.room -= 3 * len(body) + len(found[1]) + 300
            if self.room < 0:
                self.cache.clear()
                self.room = self.cache_bytes
            self.cache[body] = found
        return found

    def repaired(self, data: bytes, starts: list[int], left: int, right: int) -> tuple[int, str, bytes] | None:
        """The tokens between the word starts ``left`` and ``right`` (indices into ``starts``), around a join.

        The piece is encoded with a word more on either side; it is right when
        these words come out as in the neighbouring chunks. If not, it is
        encoded once more with twice as many; None if the whole text does not
        agree with its words.
        """
        more = 1
        while True:
            i, j = max(0, left - more), min(len(starts) - 1, right + more)
            ids = self.ids(data[starts[i] : starts[j]])
            before = self.listed(data, starts[i : left + 1])
            after = self.listed(data, starts[right : j + 1])
            if ids[: len(before)] == before and ids[len(ids) - len(after) :] == after:
                return self.shown(ids[len(before) : len(ids) - len(after)])
            if i == 0 and j == len(starts) - 1:
                return None
            more *= 2

    def parts(self, data: bytes) -> Iterator[tuple[int, str, bytes]]:
        """Number of tokens, ids as decimals, and decoded bytes of the parts of one text, in order."""
        b = np.frombuffer(data, np.uint8)
        starts = self.word_starts(b) if len(b) > 2 else np.empty(0, np.int64)
        borders = self.borders(b)
        if len(starts) < 4 or not len(borders):
            if data:
                yield self.shown(self.ids(data))
            return
        # each chunk's inside lies between its first and last word start; a chunk with fewer goes to the join around it
        edges = np.concatenate(([0], borders, [len(b)]))
        first = np.searchsorted(starts, edges[:-1] + 1)
        last = np.searchsorted(starts, edges[1:] - 1) - 1
        inside = [(f, z) for f, z in zip(first.tolist(), last.tolist()) if f < z]
        if not inside:
            yield self.shown(self.ids(data))
            return
        at = starts.tolist()
        joins = [self.repaired(data, at, z, f) for (_, z), (f, _) in zip(inside, inside[1:])]
        if None in joins:
            yield self.shown(self.ids(data))  # not by chunks, then
            return
        if at[inside[0][0]]:
            yield self.shown(self.ids(data[: at[inside[0][0]]]))
        for n, (f, z) in enumerate(inside):
            if n:
                yield joins[n - 1]
            yield self.chunk(data[at[f] : at[z]])
        yield self.shown(self.ids(data[at[inside[-1][1]] :]))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text."""
        n, ids, decoded, comma = 0, hashlib.sha256(), hashlib.sha256(), b""
        pieces = []
        for count, shown, back in self.parts(text.encode()):
            if count:
                n += count
                ids.update(comma + shown.encode())
                comma = b","
                pieces.append(back)
        decoded.update(b"".join(pieces).decode(errors="replace").encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for n, shown, _ in self.parts(text.encode()) if n for i in shown.split(",")]


def _codec(content: str) -> Codec:
    """One codec a Python worker, kept between tasks."""
    import builtins

    kept = builtins.__dict__.setdefault("_tripweave_codecs", {})
    key = hash(content)
    if key not in kept:
        kept.clear()
        kept[key] = Codec(content)
    return kept[key]


def encoded(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of each whole text; null counts as empty and gives no ids."""
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(_content(tokenizer))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(content.value)
        for batch in batches:
            ids = pa.array([codec.encode(t) for t in batch["t"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def _content(tokenizer: str | None) -> str:
    """The tokenizer file (about 1.5 MB, whatever the corpus) as text, read on the driver."""
    with open(tokenizer or public_tokenizer(), encoding="utf-8") as f:
        return f.read()


def encoded_digests(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    A null text counts as empty: no tokens, hashes of the empty string. Special
    tokens that stand in a text are encoded as such. Every row is encoded on
    its own, so ties, repeated rows and other columns do not matter; an empty
    table gives no rows. A chunk is encoded once in each Python worker that
    meets it, within CACHE_BYTES; no text is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(_content(tokenizer))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(content.value)
        for batch in batches:
            found = [codec.digest(t) for t in batch["t"].to_pylist()]
            counts, *hashes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), *(pa.array(h, pa.string()) for h in hashes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
