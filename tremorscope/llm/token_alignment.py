"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same text, and which ids go together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stored
from .packing import Encoder, tokenizer_paths

#: Bytes of text whose links share a dictionary of id pairs.
BLOCK_BYTES = 16 << 20
#: A pair of ids (a, b) is a * PAIR + b; ids of B stay below it.
PAIR = 1 << 24
#: Words whose ids a task remembers at most.
KNOWN_WORDS = 300_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the rest for U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, paths: tuple[str, str], piece_path: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = Encoder(paths)
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.special = []  # their strings are plain text, as the ranked coder takes them
        self.pieces = SentencePieceProcessor(model_file=piece_path)
        value = byte_values()
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.b_bytes = [self._piece(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        if len(self.b_bytes) > PAIR:
            raise ValueError(f"more than {PAIR} pieces")
        self.a_size, self.b_size = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as text, by tokenizer, with what follows: a comma, or the end of a group's part
        self.shown = [f"{i}{end}".encode() for tokens, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(tokens))]
        # no piece goes over a space between words, so words may be coded one by one
        self.by_word = not any("▁" in t.lstrip("▁") or t.startswith("▁▁") and t.strip("▁") for t in map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))
        self.words: dict[str, list[int]] = {}

    @staticmethod
    def _piece(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def piece_ids(self, text: str) -> np.ndarray:
        """Ids of B. Words between single spaces are coded once each while they are known; texts with other spacing are coded whole."""
        if not self.by_word or "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return np.array(self.pieces.encode(text, num_threads=1), dtype=np.int64)
        words = text.split(" ")
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        if missing := list(set(words).difference(self.words)):
            self.words.update(zip(missing, self.pieces.encode(missing, num_threads=1), strict=True))
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, words)), dtype=np.int64)

    def encoded(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A over a space and the text, and of B over the text; None unless both spell just these bytes."""
        if not text:
            return None
        spaced = " " + text
        want = spaced.encode()
        a = self.encoder(spaced)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != want:
            return None
        b = self.piece_ids(text)
        return (a.astype(np.int64), b) if b"".join(map(self.b_bytes.__getitem__, b.tolist())) == want else None


def align(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes, np.ndarray]:
    """(groups, their text, id pairs of the links) of two spellings of the same bytes.

    The ends of both, merged, cut the text into stretches, each inside one
    token of A and one of B: every overlap of two tokens is just one of them.
    Ends that both have close a group.
    """
    ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)]
    links = a[np.searchsorted(ends_a, ends)] * PAIR + b[np.searchsorted(ends_b, ends)]
    last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
    last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
    # a group's tokens of A, then those of B: each token goes behind the other side's in earlier groups (and, for B, in its own)
    groups = int(last_a.sum())
    before_a = np.cumsum(last_a) - last_a
    before_b = np.cumsum(last_b) - last_b
    of_b, of_a = np.append(0, np.flatnonzero(last_b) + 1), np.flatnonzero(last_a) + 1
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + of_b[before_a]] = a + len(pair.a_bytes) * last_a
    order[np.arange(len(b)) + of_a[before_b]] = b + len(pair.b_bytes) * last_b + 2 * len(pair.a_bytes)
    return groups, b"".join(map(pair.shown.__getitem__, order.tolist()))[:-1], links


_TEXT = pa.struct([("key", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("first", pa.int64())])
_BLOCK = {"block": pa.int64(), "pairs": pa.list_(pa.int64()), "weights": pa.list_(pa.int64()), "texts": pa.list_(_TEXT), "codes": pa.binary(), "times": pa.binary()}
BLOCKS = "block long, pairs array<long>, weights array<long>, texts array<struct<key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, first long>>, codes binary, times binary"


def aligned_blocks(texts: DataFrame, paths: tuple[str, str], piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distinct texts (text, n, key), each tokenised and aligned once, in blocks.

    A block holds its distinct id pairs with their links in all documents, its
    texts' measures, and the texts' distinct pairs as places in the block's
    dictionary with how often each occurs; a text's stand from ``first`` on.
    """

    def packed(block: int, kept: list[tuple], links: list[np.ndarray], counts: list[int]) -> pa.RecordBatch:
        n = np.array([len(x) for x in links], dtype=np.int64)
        pairs, codes = np.unique(np.concatenate(links), return_inverse=True)
        # a stretch's key is (its text, its pair's place): sorted, equal ones stand together
        keys = np.sort((np.repeat(np.arange(len(n), dtype=np.int64), n) << 32) | codes.reshape(-1))
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(head, len(keys)))
        text, code = keys[head] >> 32, (keys[head] & 0xFFFFFFFF).astype("<i4")
        weights = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(weights, code, times * np.array(counts, dtype=np.int64)[text])
        first = np.searchsorted(text, np.arange(len(n)))
        rows = [dict(zip(_TEXT.names, (*row, int(at)), strict=True)) for row, at in zip(kept, first, strict=True)]
        cells = ([block], [pairs], [weights], [rows], [code.tobytes()], [times.astype("<i4").tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, _BLOCK.values(), strict=True)], names=list(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = Pair(paths, piece_path), TaskContext.get().partitionId() << 32
        kept, links, counts, size = [], [], [], 0
        for batch in batches:
            for text, n, key in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                if (ids := pair.encoded(text)) is None:
                    continue
                groups, shown, mine = align(pair, *ids)
                kept.append((key, len(ids[0]), len(ids[1]), groups, len(mine), hashlib.sha256(shown).hexdigest()))
                links.append(mine)
                counts.append(n)
                size += len(text)
                if size >= block_bytes:
                    yield packed(block, kept, links, counts)
                    kept, links, counts, size, block = [], [], [], 0, block + 1
        if kept:
            yield packed(block, kept, links, counts)

    return texts.select("text", "n", "key").mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each id pair in all documents, and whether its B id has none with more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.weights").alias("w"))
    counts = each.groupBy("pair").agg(F.sum("w").alias("n")).withColumn("b", F.col("pair") % PAIR)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored_texts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Each text's measures: the counts of its block's pairs come to the block, whose dictionary bounds them."""
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "asked"))
    found = asked.join(counts, asked["asked"] == counts["pair"]).groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    joined = found.withColumnRenamed("block", "of").join(blocks.select("block", "texts", "codes", "times"), F.col("of") == F.col("block"))
    names = [n for n in _TEXT.names if n != "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found, texts, codes, times = (batch.column(i)[row] for i in range(4))
                at, n, best = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                size = len(at)
                count, top = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
                count[at], top[at] = n, best
                code, often = np.frombuffer(codes.as_py(), dtype="<i4"), np.frombuffer(times.as_py(), dtype="<i4").astype(np.int64)
                first = texts.values.field(len(names)).to_numpy()
                columns = [texts.values.field(i) for i in range(len(names))] + [pa.array(np.add.reduceat(often * x[code], first), pa.int64()) for x in (top, count)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum"])

    schema = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return joined.select("found", "texts", "codes", "times").mapInArrow(run, schema)


def align_tokenizers(docs: DataFrame, paths: tuple[str, str] | None = None, piece_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(measures of each document, (pair, n, best) of all id pairs).

    Texts are shuffled whole, so that each distinct one is tokenised and
    aligned once; its links count as often as it occurs. Where either
    tokenizer's tokens don't spell a space and the text, and for null and empty
    texts, a document has no tokens: zeros and an empty digest. Rows that share
    a doc_id, and rows without one, are documents of their own. No rows give no
    rows; extra columns take no part.

    A text meets its documents again by the SHA-256 of its bytes, so the join
    moves 32 bytes a document, and copies, however many, are dealt by both
    sides, where AQE may split them. Counts go to a block's distinct pairs, not
    to every link. A block holds some MB of text, or one text that is longer.
    """
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    own = docs.select(F.col("doc_id").cast("long"), "text")
    texts = own.where("text is not null and text != ''").groupBy("text").agg(F.count("*").alias("n")).withColumn("key", key)
    with arrow_batches(docs.sparkSession):
        blocks = stored(aligned_blocks(texts, paths or tokenizer_paths(), piece_path or piece_model_path()), "aligned")
        counts = stored(pair_counts(blocks), "pair-counts")
        measured = stored(scored_texts(blocks, counts), "text-measures").withColumnRenamed("key", "of")
    joined = own.select("doc_id", key.alias("key")).join(measured, F.col("key") == F.col("of"), "left")
    return joined.select("doc_id", *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), counts


def digest(docs: DataFrame) -> DataFrame:
    return align_tokenizers(docs)[0]
