"""Hierarchical best-fit packing of token pieces into sequences.

Documents are tokenised whole; those longer than a sequence are cut into full pieces, with the shorter piece first. Full
pieces are sequences of their own. All others are packed best fit, largest first, inside each partition. Bins at least
FULL of a sequence are emitted; the underfull ones become items of the next level, which deals them to fewer partitions
(by row, so that sizes mix and equal documents spread) and packs again, until a level packs in one partition. A bin is one
row with its members (at most as many as tokens), so rows never outgrow a sequence. A level whose underfull bins exceed
LEVEL_BINS for each partition keeps as many partitions as they need. Before each level the bins that not even the emptiest
other one could join are done. The tree ends when a level of one partition has run, or where over LEVEL_BINS bins that could
still be joined are left and a level saves less than one for each of its partitions.

Token ids are those of the byte-level BPE vocabulary, run by the installed rank encoder, which gives the same ids and treats
special tokens' strings as text. Its pattern can't take very long white space, so runs of LONG_SPACE or more are cut out
and merged by themselves, which is how the pattern would part them. Every document ends with END.

Defined cases: null or empty text is the single id END; very long texts, words and white space are encoded whole; rows with
a null or repeated doc_id, and repeated rows, are packed as documents of their own; equal sizes are packed in the order of
their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import few, small_batches, stored, table

LENGTH, END = 1024, 2
FULL = 0.995
LEVEL_BINS, FAN_IN = 20_000, 8
LONG_SPACE = 4096
SPACES = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}")

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(2)
def encoder(path: str, whole: bool = False):
    """whole: merges the text as one piece. It has a table of its own, so it is made only for the texts that need it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str="(?s:.+)" if whole else public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str) -> list[int]:
    parts = encoder(path)
    if len(text) < LONG_SPACE:
        return parts.encode_ordinary(text)
    out, at = [], 0
    for m in SPACES.finditer(text):
        # the last white space before a word goes with the word
        end = m.end() - (m.end() < len(text))
        out += parts.encode_ordinary(text[at : m.start()])
        out += encoder(path, True).encode_ordinary(text[m.start() : end])
        at = end
    return out + parts.encode_ordinary(text[at:])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document. vocabulary: a path that every executor can open."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*token_ids(text or "", path), END], "<u4")
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                out += [(doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Largest first, each into the fullest bin that takes it. Returns the members of each bin."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms: list[int] = []  # sorted, of bins that aren't full
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(k)
            bins[at].append(i)
        else:
            room, at = length, len(bins)
            bins.append([i])
        if left := room - size:
            if not open_by_room[left]:
                insort(rooms, left)
            open_by_room[left].append(at)
    return bins


def pack(items: DataFrame, length: int = LENGTH, full: float = FULL, level_bins: int = LEVEL_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """items: (doc_id, piece, start, length, ids_crc32), each of length tokens at most, stored. Adds sequence_id and offset."""
    member = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
    bins = items.select(F.struct("doc_id", "piece", "start", "length", "ids_crc32").alias("m"), "length").select(F.array("m").alias("members"), F.col("length").alias("used"))
    done = [bins.filter(F.col("used") >= length).select("members")]
    bins = bins.filter(F.col("used") < length)
    limit = int(length * full)

    def open_bins(bins: DataFrame) -> tuple[DataFrame, int]:
        """The bins that the emptiest other one could still join, and their number; the rest is done."""
        two = [r.used for r in bins.select("used").orderBy("used").limit(2).collect()]
        fits = F.col("used") <= (length - two[0] if len(two) == 2 and sum(two) <= length else -1)
        done.append(bins.filter(~fits).select("members"))
        rest = bins.filter(fits)
        return rest, rest.count()

    bins, count = open_bins(bins)
    parts = max(1, -(-count // level_bins))
    while count:
        last = parts == 1

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:  # a partition without rows may come without batches
                return
            t = pa.Table.from_batches(got)
            used, members = t.column("used").to_numpy(), t.column("members").combine_chunks()
            members = members.combine_chunks() if isinstance(members, pa.ChunkedArray) else members
            first, flat = members.offsets.to_numpy(), members.values
            groups = best_fit(used, length)
            picked = np.concatenate([np.arange(first[i], first[i + 1]) for g in groups for i in g])
            sizes = np.array([sum(first[i + 1] - first[i] for i in g) for g in groups])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat.take(pa.array(picked)))
            total = np.array([used[g].sum() for g in groups])
            yield pa.RecordBatch.from_arrays([lists, pa.array(total, pa.int64()), pa.array((total >= limit) | last, pa.bool_())], ["members", "used", "out"])

        # bins is a stored table, so any attempt gives a row the same number
        dealt = bins.repartition(parts, F.xxhash64(F.monotonically_increasing_id(), F.lit(parts)))
        level = stored(dealt.mapInArrow(run, f"members array<{member}>, used long, out boolean"), "packing-level")
        done.append(level.filter("out").select("members"))
        before = count
        bins, count = open_bins(level.filter("not out").select("members", "used"))
        if count > level_bins and before - count < parts:  # of so many, each level would join hardly one in a partition
            done.append(bins.select("members"))
            break
        parts = max(1, min(-(-parts // fan_in), parts - 1), -(-count // level_bins) if count > level_bins else 1)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    # every part of out is a stored table, so a repeated task reads the same rows and gives the same ids
    one = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    spread = one.select("sequence_id", F.posexplode("members").alias("k", "m"), F.transform("members", lambda x: x["length"]).alias("sizes"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    return spread.select("m.*", "sequence_id", before.alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(table(spark, sf_dir, "documents")), "packing-pieces"))
