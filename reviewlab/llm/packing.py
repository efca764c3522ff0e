"""Best-fit packing of documents into sequences of bounded length: hierarchical residual packing.

1. Every document becomes token ids plus an end id. Only documents longer than a sequence are cut; the first piece
   takes the remainder, so all others are full sequences of their own.
2. Each partition packs its pieces by best fit, longest first. Sequences that are nearly full are done.
3. Underfull sequences become items themselves. Groups of ``fan_in`` tasks best-fit them again, round after round, until
   one group is left. After a best fit no two sequences of a task fit together but through at most one that is half
   empty or more, so a task hands on its emptiest ``MAX_OPEN`` sequences only; the others are final as they are. What a
   task holds is bounded by ``LOCAL_ITEMS`` and ``fan_in * MAX_OPEN`` whatever the input.

Defined results: a null or empty text is the end id alone; a null id is packed like any other; rows that repeat an id
are packed each; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import batched, keyed, release_memory
from reviewlab.session import durable

LOCAL_ITEMS = 500_000
MAX_OPEN = 4_096
CACHED_CHUNKS = 100_000
CACHED_PARTS = 400_000
BIN_BITS = 40
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)


class PartIds(dict):
    """Ids by part; a part that is missing comes over from the older half or is found."""

    def __init__(self, older: dict[str, bytes], find: Callable[[str], bytes]) -> None:
        self.older, self.find = older, find

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.find(part)
        self[part] = found
        return found


class ChunkedTokenizer:
    """Token ids of whole texts from the ids of parts that recur, each found once.

    Texts of characters whose class is beyond doubt (``DOUBT``) are cut into pre-tokens by the pre-tokenizer's own pattern;
    the model's merges give the ids of each. Other texts are cut where that is safe: a byte-level pre-tokenizer never joins
    a space that precedes a non-blank, a single line break between non-blanks, or the marks after a letter or digit to what
    stands before them, so texts may be cut there: into chunks at spaces, and new chunks into parts at line breaks and
    closing marks. A part of letters only, with or without a space before it, is
    one pre-token, so the model's own merges give its ids without another scan; other parts go through the tokenizer.
    """

    LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ͳΑ-ΡΣ-ώА-яѐ-џ"
    DOUBT = re.compile(rf"[^\n\x20-~‐-‧{LETTERS}]")
    PRE_TOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
    ASCII_PRE_TOKENS = re.compile(PRE_TOKENS.pattern.replace(LETTERS, "A-Za-z"))
    INNER_BLANK = re.compile(r" (?:\s|$)")
    CUT = re.compile(r" (?=\S)")
    MARKS = ".,;:!?"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        steps = json.loads(self.tokenizer.to_str())
        cut = steps.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.letters_alone = plain and not steps.get("normalizer") and not any(t.content.strip().isalpha() for t in added)
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
        self.bytes_as_text = byte_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts = PartIds({}, self.merged)

    def chunks(self, text: str) -> list[str]:
        return self.CUT.split(text) if self.INNER_BLANK.search(text) else text.split(" ")

    def split_marks(self, word: str) -> list[str]:
        stem = word.rstrip(self.MARKS)
        return [word] if stem == word or not stem[-1:].isalnum() else [stem, word[len(stem) :]]

    def split(self, chunk: str) -> list[str]:
        if "\n" not in chunk:
            return self.split_marks(chunk)
        lines = chunk.split("\n")
        if any(not x or x == " " or x[at].isspace() or x[-1].isspace() for x, at in zip(lines, [chunk[0] == " ", *[0] * len(lines)])):
            return [chunk]
        parts = self.split_marks(lines[0])
        for line in lines[1:]:
            parts += ["\n", *self.split_marks(line)]
        return parts

    def part_ids(self, part: str) -> bytes:
        if self.letters_alone and (part[1:] if part[0] == " " else part).isalpha():
            return self.parts[part]
        found = self.parts.get(part)
        if found is None:
            found = self.parts.older.get(part)
            if found is None:
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.parts[part] = found
        return found

    def merged(self, pre_token: str) -> bytes:
        if pre_token.isascii() and pre_token.isprintable():
            whole = pre_token.replace(" ", self.bytes_as_text[32])
        else:
            whole = pre_token.encode().decode("latin-1").translate(self.bytes_as_text)
        ids = [t.id for t in self.model.tokenize(whole)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk_ids(self, chunk: str) -> bytes:
        """Of a chunk that stands after a space and is not in ``known``."""
        found = self.older.get(chunk)
        if found is None:
            stem = chunk.rstrip(self.MARKS)
            if stem.isalpha():
                found = self.part_ids(" " + stem)
                if stem != chunk:
                    found += self.part_ids(chunk[len(stem) :])
            else:
                found = b"".join(map(self.part_ids, self.split(" " + chunk)))
        if len(self.known) >= CACHED_CHUNKS:
            self.known, self.older = {}, self.known
        self.known[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.parts) >= CACHED_PARTS:  # what is still in use comes over from the older half when it is next met
            older, self.parts = self.parts, PartIds({}, self.merged)
            self.parts.older, older.older = older, {}
        if self.letters_alone and not self.DOUBT.search(text) and not self.added.search(text):
            cut = self.ASCII_PRE_TOKENS if text.isascii() else self.PRE_TOKENS
            return b"".join(map(self.parts.__getitem__, cut.findall(text)))
        chunks = self.chunks(text)
        ids = list(map(self.known.get, chunks))
        ids[0] = b"".join(map(self.part_ids, self.split(chunks[0]))) if chunks[0] else b""
        if None in ids:
            ids = [self.chunk_ids(c) if i is None else i for c, i in zip(chunks, ids)]
        return b"".join(ids)

    def rest(self) -> None:
        """Between tasks only the younger halves are kept."""
        self.older, self.parts.older = {}, {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself if visible, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkedTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkedTokenizer(path)


def piece_bounds(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full ones."""
    if n <= width:
        return [(0, n)]
    first = n % width or width
    return [(0, first), *((at, width) for at in range(first, n, width))]


def token_pieces(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document. One pass, no shuffle."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(names), 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for name, ids in zip(names[at : at + 256], encoder.encode_batch(part)):
                    ids += end
                    for k, (start, n) in enumerate(piece_bounds(len(ids) // 4, width)):
                        yield name, k, start, n, ids[4 * start : 4 * (start + n)]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), PIECES, 1024)
        _tokenizer(tokenizer).rest()
        release_memory()

    return keyed(docs).mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: bin and offset of every item, and how full each bin is.

    Open bins are stacked by the room they have left; a bit mask over the rooms finds the tightest in one step.
    """
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(width + 1)]
    mask = 0
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = values[i]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = width, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, used


def pack_locally(pieces: DataFrame, width: int) -> DataFrame:
    """Adds bin, bin_offset and bin_used: best fit inside each partition, ``LOCAL_ITEMS`` pieces at a time."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, made = [], 0, TaskContext.get().partitionId() << BIN_BITS

        def placed(table: pa.Table, first: int) -> tuple[pa.Table, int]:
            bins, offsets, used = best_fit(table["length"].to_numpy(), width)
            columns = {"bin": bins + first, "bin_offset": offsets, "bin_used": np.array(used, np.int64)[bins]}
            for name, values in columns.items():
                table = table.append_column(name, pa.array(values, pa.int64()))
            return table, first + len(used)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= LOCAL_ITEMS:
                table, made = placed(pa.Table.from_batches(held), made)
                yield from table.combine_chunks().to_batches(max_chunksize=10_000)
                held, count = [], 0
        if held:
            yield from placed(pa.Table.from_batches(held), made)[0].combine_chunks().to_batches(max_chunksize=10_000)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(local, f"{fields}, bin bigint, bin_offset bigint, bin_used bigint")


OPEN = "root bigint, used bigint, grp bigint, bins array<bigint>, bases array<bigint>, closed boolean"


def _merge_round(width: int, slack: int, last: bool):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "root"], ascending=[False, True], ignore_index=True)
        bins, offsets, used = best_fit(frame["used"].to_numpy(), width)
        out: list = [None] * len(used)
        items = zip(frame["root"].tolist(), frame["grp"].tolist(), frame["bins"], frame["bases"])
        for b, offset, (root, grp, inner, bases) in zip(bins.tolist(), offsets.tolist(), items):
            if out[b] is None:  # the longest item of a bin comes first and gives it its name
                out[b] = [root, used[b], grp, list(inner), list(bases)]
            else:
                out[b][3] += [root, *inner]
                out[b][4] += [offset, *(offset + base for base in bases)]
        merged = pd.DataFrame(out, columns=["root", "used", "grp", "bins", "bases"])
        emptiest = merged["used"].rank(method="first") <= MAX_OPEN
        merged["closed"] = last | ~emptiest | (merged["used"] > width - slack)
        return merged

    return merge


def merge_underfull(placed: DataFrame, width: int, slack: int, fan_in: int) -> DataFrame:
    """bin, root, base: underfull bins that moved into another one, and where they begin there."""
    heads = placed.where((F.col("bin_offset") == 0) & (F.col("bin_used") <= width - slack))
    none = F.array().cast("array<bigint>")
    level = heads.select(
        F.col("bin").alias("root"),
        F.col("bin_used").alias("used"),
        F.shiftright("bin", BIN_BITS).alias("grp"),
        none.alias("bins"),
        none.alias("bases"),
    )
    groups = (level.agg(F.max("grp").alias("g")).first()["g"] or 0) + 1
    done = []
    while True:
        groups = -(-groups // fan_in)
        level = level.withColumn("grp", F.floor(F.col("grp") / fan_in))
        merged = durable(level.groupBy("grp").applyInPandas(_merge_round(width, slack, groups == 1), OPEN))
        done.append(merged.where("closed").select(F.explode(F.arrays_zip("bins", "bases")).alias("m"), "root"))
        if groups == 1:
            break
        level = merged.where("NOT closed").drop("closed")
    moves = reduce(DataFrame.union, done)
    return moves.select(F.col("m.bins").alias("bin"), "root", F.col("m.bases").alias("base"))


def pack(pieces: DataFrame, width: int = 1024, slack: int = 4, fan_in: int = 16) -> DataFrame:
    """``pieces`` (a ``length`` column and any others) with ``sequence_id`` and ``offset``."""
    placed = durable(pack_locally(durable(pieces), width))
    moves = merge_underfull(placed, width, slack, fan_in)
    return placed.join(moves, "bin", "left").select(
        *[f"`{c}`" for c in pieces.columns],
        F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("base", F.lit(0))).cast("bigint").alias("offset"),
    )


def token_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths of packed pieces that carry their ``ids``: the sequences to train on."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def pack_documents(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = token_pieces(docs, tokenizer, width, end_id)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), width)
