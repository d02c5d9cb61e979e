"""Hierarchical residual packing: best fit within partitions, then a tree of merges of the underfull bins.

Documents become token ids and an end token; longer ones than a sequence are cut into pieces, of which only the first may be short.
Each task packs its pieces by best fit, longest first, and nearly full bins are done. The bins left
over go up a tree as items of their length: in each round the groups hold a bounded number of bins, are packed
by best fit again, give off what is nearly full, and fewer groups are left; it ends with one group, or when a round
brings no gain.

Defined cases: a null or empty text is one piece with the end token alone; repeated rows are packed each; rows keep
their doc_id, null included; strings of added tokens are those tokens, as the library reads them; runs of a million blanks
or letters are encoded like any text; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, broadcast_if_small, check_columns, emit, rows, staged

#: Bins in one group of a merge round at most, and groups that one group of the next round takes in.
GROUP_BINS, FAN_IN = 20_000, 8
#: Runs of white space, letters, digits or other signs from this length on are left to the tokenizers library.
LONG_RUN = 5_000
_encoders: dict[str, object] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes, by rule: printable Latin-1 stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from text to token ids, those of the tokenizers library for a byte-level BPE file (add_special_tokens=False).

    The file's vocabulary is loaded into tiktoken, whose merges are several times as fast. The tokenizers library itself encodes
    texts that quote an added token or hold a long run of white space or of one kind of characters (tiktoken's patterns run out of stack on those), texts on
    which tiktoken fails, and all texts where the vocabulary isn't in the order of its merges or the two disagree on a probe.
    """
    if path not in _encoders:
        _encoders[path] = _load(path)
    return _encoders[path]


def _load(path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return plain.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, special = _byte_symbols(), {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    except (KeyError, ValueError):
        return slow
    odd = re.compile("|".join([*map(re.escape, sorted(special)), rf"\s{{{LONG_RUN},}}", rf"[^\W\d_]{{{LONG_RUN},}}", rf"\d{{{LONG_RUN},}}", rf"[^\w\s]{{{LONG_RUN},}}"]))

    def both(text: str) -> list[int]:
        if odd.search(text):
            return slow(text)
        try:
            return fast(text)
        except BaseException as failed:  # what the library raises on a panic is no Exception
            if isinstance(failed, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return slow(text)

    probe = "Added 12 of it's naïve ñandú's, Straße\t\n  x  — 東京 🙂 don't <|endoftext|> WE'LL 3.14%%%\r\n" + base64.b64encode(bytes(range(256))).decode()
    return both if both(probe) == slow(probe) and fast(probe.replace("<|endoftext|>", "")) == slow(probe.replace("<|endoftext|>", "")) else slow


def best_fit(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: for each item its bin and offset, and the fill of each bin."""
    room: list[int] = []  # the distinct free spaces, sorted
    bins: dict[int, list[int]] = {}
    where, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[k]
        at = bisect_left(room, size)
        if at < len(room):
            free = room[at]
            b = bins[free].pop()
            if not bins[free]:
                del bins[free], room[at]
        else:
            b, free = len(fill), limit
            fill.append(0)
        where[k], offset[k] = b, fill[b]
        fill[b] += size
        if free > size:
            left = free - size
            if left not in bins:
                insort(room, left)
                bins[left] = []
            bins[left].append(b)
    return where, offset, fill


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_fill long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "bin", "bin_offset", "bin_fill")]])


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, text: str, doc_id: str) -> DataFrame:
    """Each document's pieces, packed within its task; bins are numbered by task and place."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        out = {n: [] for n in _PIECE_ARROW.names}
        for i, t in rows(batches, "__id", "__text"):
            ids = np.array([*encode(t or ""), end_id], "<u4")
            first = len(ids) % limit or limit
            cuts = [0, *range(first, len(ids) + 1, limit)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for n, v in zip(_PIECE_ARROW.names, (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=False):
                    out[n].append(v)
        where, offset, fill = best_fit(out["length"], limit)
        base = TaskContext.get().partitionId() << 36
        out |= {"bin": [base + b for b in where], "bin_offset": offset, "bin_fill": [fill[b] for b in where]}
        for at in range(0, len(where), 50_000):
            yield emit({n: v[at : at + 50_000] for n, v in out.items()}, _PIECE_ARROW)

    given = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return given.mapInArrow(run, _PIECE)


_MOVE = "bin long, into long, at long, fill long"


def _round(bins: DataFrame, groups: int, limit: int, turn: int) -> DataFrame:
    """Pack each group's bins(bin, fill) as items; a bin that others join keeps its number."""
    schema = pa.schema([(n, pa.int64()) for n in ("bin", "into", "at", "fill")])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("fill", "descending"), ("bin", "ascending")])
        names, sizes = group.column("bin").to_pylist(), group.column("fill").to_pylist()
        where, at, fill = best_fit(sizes, limit)
        host: dict[int, int] = {}
        for name, b in zip(names, where, strict=True):
            host.setdefault(b, name)
        return pa.table([pa.array(x, pa.int64()) for x in (names, [host[b] for b in where], at, [fill[b] for b in where])], schema=schema)

    dealt = bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack, _MOVE)


def merge(bins: DataFrame, limit: int, full: int) -> DataFrame | None:
    """(bin, into, at): where the contents of the underfull bins(bin, fill) end up; None if there are none."""
    moved, turn, groups = None, 0, 0
    left = bins.filter(F.col("bin_fill") < full).select("bin", F.col("bin_fill").alias("fill")).distinct()
    left = staged(left, "bins")
    n = left.count()
    while n:
        need = -(-n // GROUP_BINS)
        groups = need if not groups else max(1, min(groups - 1, max(need, -(-groups // FAN_IN))))
        step = staged(_round(left, groups, limit, turn), "merged")
        now = step.select("bin", "into", "at")
        if moved is None:
            moved = now
        else:
            m, s = moved.alias("m"), now.alias("s")
            moved = m.join(s, F.col("m.into") == F.col("s.bin"), "left")
            moved = moved.select("m.bin", F.coalesce("s.into", "m.into").alias("into"), (F.col("m.at") + F.coalesce("s.at", F.lit(0))).alias("at"))
        left = step.filter(f"bin = into AND fill < {full}").select("bin", "fill")
        before, n, turn = n, left.count(), turn + 1
        if groups == 1 or n == before:
            break
    return moved


def pack(
    docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, full: float = 0.998, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``full``: bins filled so far don't go up the tree."""
    check_columns(docs, text, doc_id)
    held = staged(pieces(docs, tokenizer, limit, end_id, text, doc_id), "pieces")
    moved = merge(held, limit, int(limit * full))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        out = held.select(*own, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    else:
        moved = staged(moved, "moved").withColumnRenamed("bin", "from")
        out = held.join(broadcast_if_small(moved), F.col("bin") == F.col("from"), "left").select(
            *own, F.coalesce("into", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("at", F.lit(0))).alias("offset")
        )
    return out if doc_id == "doc_id" else out.withColumnRenamed("doc_id", doc_id)
