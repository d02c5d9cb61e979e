"""Exact repeated passages across documents, by suffix arrays over the places that may repeat.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed. To find
them without one suffix array over all text:

1. *Anchors.* Each window of ``length`` bytes picks the k-gram with the smallest hash in it, so equal windows pick
   equal k-grams, at equal places. Numbers of picked k-grams are dealt to buckets, deduplicated within chunks of
   documents, and those found in several documents are reported back to their chunks. All other windows can't repeat.
2. *Within a chunk* the suffixes of the stretches around shared anchors are sorted in two stages (suffix_array), and runs of
   neighbours with common prefixes of ``length`` bytes give the smallest document of the chunk that has each window.
3. *Across chunks* each stretch (the bytes that the windows of one anchor cover) goes to its anchor's bucket, once per chunk, with the
   smallest id that has it; those of an anchor that very many chunks have are dealt out window by window instead. The bucket's stretches are
   laid end to end, and their suffixes and common prefixes give the smallest document of each window over all chunks.
4. The verdicts, a bit for each window, go back to the chunks. A byte goes if either order finds a smaller document for a window over it.

Whether a window repeats is told by the sorted suffixes alone; sending equal stretches of a chunk once only combines them before
the shuffle, so that a group of copies, whole documents included, costs a bucket one stretch per chunk. Buckets and partitions
follow the bytes of the input, so tasks stay of one size. Bodies travel compressed. Each step ends in a table in the shared folder.

Defined cases: null and empty texts have no bytes; documents shorter than ``length`` lose nothing; rows that share an
id don't remove from each other; a null id counts as larger than all ids and not smaller than another null; repeated rows are all
returned; a document longer than a chunk is one of its own, and needs about 60 bytes of memory a byte of its text; extra columns are
ignored or kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from gleaner.llm.common import bounded_batches, check_columns, emit, rows, staged, trim
from gleaner.llm.suffix_array import common_prefixes, suffix_array

CHUNK_BYTES, BUCKET_BYTES = 1_000_000, 4_000_000
#: Bytes of text that one partition of chunks stands for.
PART_BYTES = 8_000_000
#: Bytes of an anchor; windows and their bits follow from it.
K = 20
#: Suffixes in one suffix array; more stretches in a bucket are taken by anchor in parts.
ARRAY_BYTES = 1_500_000
#: An anchor in more chunks than this doesn't gather its stretches in one bucket: each of their windows goes to a bucket of its own hash.
HOT_CHUNKS = 4000
_LARGEST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _small_hashes(t: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each K-gram (K = 20), by which windows pick."""
    h, p, four = t.astype(np.uint32), np.uint32(0x9E3779B1), None
    h += np.uint32(1)
    with np.errstate(over="ignore"):
        n = 1
        while n < 16:
            h = h[:-n] * p + h[n:]
            p, n = p * p, 2 * n
            if n == 4:
                four, by = h, p
        h = h[:-4] * by + four[16:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return h


def _gram_hashes(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of a hash of the K-grams at the given places."""
    words = np.lib.stride_tricks.sliding_window_view(t, 8)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for shift in (0, 8, K - 8):
            h ^= np.ascontiguousarray(words[at + shift]).view("<u8").ravel()
            h *= _MIX
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


def anchors(t: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end in t: for each run of windows that pick one anchor, the document, first window, last window, the anchor's place, its hash."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(t) < length:
        return none
    # hash and place in one number: the least of them is the leftmost of the least hashes
    value = _small_hashes(t).astype(np.uint64)
    value <<= np.uint64(32)
    value |= np.arange(len(value), dtype=np.uint64)
    span, width = 1, length - K + 1
    while 2 * span <= width:
        value = np.minimum(value[span:], value[:-span])
        span *= 2
    if span < width:
        value = np.minimum(value[width - span :], value[: span - width])
    ends = np.cumsum(sizes)
    valid = np.ones(len(value) + length - 1, bool)
    for back in range(1, length):
        at = ends - back
        valid[at[at >= ends - sizes]] = False
    starts = np.flatnonzero(valid[: len(value)])
    if not len(starts):
        return none
    place = value[starts].astype(np.uint32)  # the low half
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, picked = starts[first], place[first].astype(np.int64)
    return np.searchsorted(ends, low, "right"), low, starts[last], picked, _gram_hashes(t, picked)


def _numbers(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 bits of each anchor's hash, as one number."""
    return ((h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))


def _packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by_bucket(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted numbers."""
    bucket = (numbers >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    if not len(cuts):
        return
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(numbers)], strict=True):
        yield int(bucket[a]), a, b


def _packed_body(body: bytes) -> bytes:
    """Bodies are written once and shuffled twice, so they are packed well."""
    return pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents (__id, __key, __rest, __body) in chunks, one row each, bodies end to end and compressed."""
    kind = docs.schema["__rest"].dataType
    longs = ArrayType(LongType())
    out = StructType().add("chunk", "long").add("ids", longs).add("keys", longs).add("rests", ArrayType(kind)).add("sizes", longs).add("raw", "long").add("body", "binary")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            body = b"".join(h[3] for h in held)
            packed = _packed_body(body) if body else b""
            ids, keys, rests, bodies = (list(x) for x in zip(*held, strict=True))
            return emit({"chunk": [number], "ids": [ids], "keys": [keys], "rests": [rests], "sizes": [[len(b) for b in bodies]], "raw": [len(body)], "body": [packed]}, schema)

        for i, k, r, b in rows(batches, "__id", "__key", "__rest", "__body"):
            if held and size + len(b) > CHUNK_BYTES:
                yield chunk()
                number, held, size = number + 1, [], 0
            held.append((i, k, r, b))
            size += len(b) + 16
        if held:
            yield chunk()

    return docs.select("__id", "__key", "__rest", "__body").mapInArrow(run, out)


class _Chunk:
    def __init__(self, row: dict) -> None:
        self.number, self.keys, self.rests = row["chunk"], row["keys"], row["rests"]
        self.ids, self.sizes = np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64)
        self.body = pa.decompress(row["body"], row["raw"], codec="zstd", asbytes=True) if row["raw"] else b""
        self.t = np.frombuffer(self.body, np.uint8)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Chunk, dict]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield _Chunk(row), row
            trim()


def _anchor_lists(chunks: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, chunk, ids): the anchors of each chunk, each once, or twice if several of its documents have it."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _opened(batches):
            doc, _, _, _, h = anchors(chunk.t, chunk.sizes, length)
            number = _numbers(h, buckets)
            order = np.lexsort((doc, number))
            number, doc = number[order], doc[order]
            keep = np.ones(len(number), bool)
            keep[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
            number = number[keep]
            third = np.zeros(len(number), bool)
            third[2:] = (number[2:] == number[1:-1]) & (number[2:] == number[:-2])
            number = number[~third]
            parts = list(_by_bucket(number))
            yield emit({"bucket": [p[0] for p in parts], "chunk": [chunk.number] * len(parts), "ids": [_packed(number[a:b] & np.uint64((1 << 40) - 1)) for _, a, b in parts]}, schema)

    return chunks.mapInArrow(run, "bucket long, chunk long, ids binary")


def _shared(lists: DataFrame, parts: int) -> DataFrame:
    """(chunk, bucket, ids, hot) of anchors that several documents have, and of those among them that very many chunks have."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("ids", pa.binary()), ("hot", pa.binary())])
    most = HOT_CHUNKS

    def run(table: pa.Table) -> pa.Table:
        sets = [_unpacked(x) for x in table["ids"].to_pylist()]
        own_sets = [np.unique(s) for s in sets]
        every = np.sort(np.concatenate(sets))
        several = np.unique(every[1:][every[1:] == every[:-1]])
        present, times = np.unique(np.concatenate(own_sets), return_counts=True)
        hot = present[times > most]
        out = {n: [] for n in schema.names}
        for c, b, own in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), own_sets, strict=True):
            at = np.minimum(np.searchsorted(several, own), max(len(several) - 1, 0))
            own = own[several[at] == own] if len(several) else own[:0]
            if len(own):
                for n, v in zip(out, (c, b, _packed(own), _packed(np.intersect1d(own, hot))), strict=True):
                    out[n].append(v)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return lists.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "chunk long, bucket long, ids binary, hot binary")


def _among(number: np.ndarray, shared: list[dict] | None, which: str) -> np.ndarray:
    """Which anchors are in the chunk's lists of that kind."""
    parts = [_unpacked(s[which]) | (np.uint64(s["bucket"]) << np.uint64(40)) for s in shared or []]
    sought = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
    if not len(sought):
        return np.zeros(len(number), bool)
    return sought[np.minimum(np.searchsorted(sought, number), len(sought) - 1)] == number


def _stretches(chunk: _Chunk, shared: list[dict] | None, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list]]:
    """Occurrences of stretches (document, first window, last window), their anchors and the numbers of their distinct stretches, and these.

    Distinct stretches, in order of occurrence: [bucket, bytes, anchor's offset, smallest id].
    """
    doc, low, high, place, h = anchors(chunk.t, chunk.sizes, length)
    number = _numbers(h, buckets)
    hit = _among(number, shared, "ids")
    doc, low, high, place, number = doc[hit], low[hit], high[hit], place[hit], number[hit]
    bucket = (number >> np.uint64(40)).astype(np.int64)
    if (hot := _among(number, shared, "hot")).any():
        # window by window, to buckets of their own
        many = (high - low + 1)[hot]
        at = np.repeat(low[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = np.array([zlib.crc32(chunk.body[a : a + length]) for a in at.tolist()], np.int64) % buckets
        doc, place, bucket, number = (np.concatenate([x[~hot], np.repeat(x[hot], many)]) for x in (doc, place, bucket, number))
        low, high = np.concatenate([low[~hot], at]), np.concatenate([high[~hot], at])
        bucket[len(bucket) - len(own) :] = own
    known: dict[tuple[int, bytes], int] = {}
    distinct: list[list] = []
    which = np.empty(len(doc), np.int64)
    body, ids = chunk.body, chunk.ids.tolist()
    for n, (d, a, b, p, x) in enumerate(zip(doc.tolist(), low.tolist(), high.tolist(), place.tolist(), bucket.tolist(), strict=True)):
        text = body[a : b + length]
        k = known.setdefault((x, text), len(distinct))
        if k == len(distinct):
            distinct.append([x, text, p - a, ids[d]])
        elif ids[d] < distinct[k][3]:
            distinct[k][3] = ids[d]
        which[n] = k
    return np.stack([doc, low, high]), number, which, np.array([d[0] for d in distinct], np.int64), distinct


def _contexts(chunks: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, chunk, n, smallest, offsets, ends, raw, body): the distinct stretches of each chunk by bucket."""
    names = ("bucket", "chunk", "smallest", "offsets", "ends", "raw", "body")
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("smallest", pa.binary()), ("offsets", pa.binary()), ("ends", pa.binary()), ("raw", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in _opened(batches):
            _, _, _, of, distinct = _stretches(chunk, row["shared"], buckets, length)
            out: dict[str, list] = {n: [] for n in names}
            order = np.argsort(of, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                some = [distinct[k] for k in part.tolist()]
                body = b"".join(s[1] for s in some)
                values = (
                    some[0][0], chunk.number, np.array([s[3] for s in some], "<i8").tobytes(), np.array([s[2] for s in some], np.uint8).tobytes(),
                    np.cumsum([len(s[1]) for s in some]).astype("<i4").tobytes(), len(body), pa.compress(body, codec="zstd", asbytes=True),
                )
                for n, v in zip(names, values, strict=True):
                    out[n].append(v)
            yield emit(out, schema)

    return chunks.mapInArrow(run, "bucket long, chunk long, smallest binary, offsets binary, ends binary, raw long, body binary")


def window_owners(texts: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, least): for each window of each text, by their numbers, the smallest owner of any text that holds the window."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    t = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # a byte that UTF-8 doesn't use
    starts = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - length, 0)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    is_window = np.arange(len(t)) < (starts + many)[text_of]
    order = suffix_array(t, length, is_window)
    order = order[is_window[order]]
    new = common_prefixes(t, order, length) < length
    first = np.flatnonzero(new)
    of = text_of[order]
    least = np.minimum.reduceat(owner[of], first) if len(first) else np.zeros(0, np.int64)
    return of, order - starts[of], least[np.cumsum(new) - 1]


def local_hits(chunk: _Chunk, doc: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, length: int, most: int) -> np.ndarray:
    """The starts of windows among those given that a document of the chunk with a smaller id has too.

    Equal windows have equal anchors, so windows of anchors that one document of the chunk alone has are left out, and a chunk of over
    most bytes, that of a very long document, is taken in parts by anchor.
    """
    hits = [low[:0]]
    each = np.lexsort((doc, anchor))
    new = np.ones(len(each), bool)
    new[1:] = anchor[each][1:] != anchor[each][:-1]
    group = np.cumsum(new) - 1
    if not len(each):
        return hits[0]
    several = doc[each][np.append(np.flatnonzero(new)[1:], len(each)) - 1] != doc[each][np.flatnonzero(new)]
    some = np.zeros(len(each), bool)
    some[each] = several[group]
    doc, low, high, anchor = doc[some], low[some], high[some], anchor[some]
    parts = -(-len(chunk.t) // most)
    for part in range(parts):
        some = np.flatnonzero(anchor % np.uint64(parts) == part)
        if not len(some):
            continue
        # windows low..high that follow each other make one passage of a document
        some = some[np.argsort(low[some], kind="stable")]
        d, first_, last_ = doc[some], low[some], np.maximum.accumulate(high[some])
        new = np.ones(len(some), bool)
        new[1:] = (d[1:] != d[:-1]) | (first_[1:] > last_[:-1] + 1)
        first = np.flatnonzero(new)
        starts, ends = first_[first], last_[np.append(first[1:], len(some)) - 1] + length
        owners = chunk.ids[d[first]]
        texts = [chunk.body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        of, window, least = window_owners(texts, owners, length)
        hits.append((starts[of] + window)[least < owners[of]])
    return np.concatenate(hits)


def _verdicts(contexts: DataFrame, length: int, parts: int) -> DataFrame:
    """(chunk, bucket, bits): for each distinct stretch of the chunk, a bit per window that a smaller document has."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
    windows = length - K + 1

    def run(table: pa.Table) -> pa.Table:
        texts: list[bytes] = []
        owner: list[np.ndarray] = []
        groups: dict[bytes, list[int]] = {}
        for smallest, offsets, ends, raw, body in zip(*(table[n].to_pylist() for n in ("smallest", "offsets", "ends", "raw", "body")), strict=True):
            body, at = pa.decompress(body, raw, codec="zstd", asbytes=True), 0
            owner.append(np.frombuffer(smallest, "<i8"))
            for off, end in zip(offsets, np.frombuffer(ends, "<i4").tolist(), strict=True):
                groups.setdefault(body[at + off : at + off + K], []).append(len(texts))
                texts.append(body[at:end])
                at = end
        owners = np.concatenate(owner)
        # least[k, j]: the smallest document that has window j of stretch k, by the order of all suffixes of its anchor's stretches; one alone has its own
        least = np.repeat(owners[:, None], windows, 1)
        part, size = [], 0
        for g in [*(g for g in groups.values() if len(g) > 1), None]:
            if part and (g is None or size > ARRAY_BYTES):
                of, window, found = window_owners([texts[k] for k in part], owners[part], length)
                least[np.array(part)[of], window] = found
                part, size = [], 0
            if g:
                part += g
                size += sum(len(texts[k]) for k in g)
        weights = np.uint64(1) << np.arange(windows, dtype=np.uint64)
        bits = ((least < owners[:, None]) @ weights).astype("<u4")
        cuts = np.cumsum([0, *map(len, owner)]).tolist()
        out = [bits[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        del texts, groups, least, bits
        trim()
        return pa.table([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(out, pa.binary())], schema=schema)

    return contexts.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "chunk long, bucket long, bits binary")


def _whole(data: bytes) -> bytes:
    """Without the bytes of characters that a cut went through."""
    return data.decode("utf-8", "ignore").encode()


def _cut(chunks: DataFrame, buckets: int, length: int, with_text: bool) -> DataFrame:
    kind = chunks.schema["rests"].dataType.elementType
    result = StructType().add("__id", "long").add("__key", "long").add("__rest", kind).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    schema = to_arrow_schema(result)
    windows = length - K + 1

    def gone(chunk: _Chunk, row: dict) -> np.ndarray:
        """Which bytes of the chunk go."""
        cover = np.zeros(len(chunk.t) + 1, np.int64)
        if not row["verdicts"]:
            return cover[:-1] > 0
        (doc, low, high), anchor, which, of, distinct = _stretches(chunk, row["shared"], buckets, length)
        bits = np.zeros(len(distinct), np.uint64)
        order = np.argsort(of, kind="stable")
        by = {v["bucket"]: np.frombuffer(v["bits"], "<u4") for v in row["verdicts"]}
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
            bits[part] = by[int(of[part[0]])]
        # within the chunk: by the order of the suffixes of its own stretches
        start = local_hits(chunk, doc, low, high, anchor, length, 2 * max(ARRAY_BYTES, CHUNK_BYTES))
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        # across chunks: for the occurrences that have the smallest id of their stretch, the others are later in this very chunk
        least = np.array([d[3] for d in distinct], np.int64)[which]
        first = np.flatnonzero((chunk.ids[doc] == least) & (bits[which] > 0))
        set_ = (bits[which[first]][:, None] >> np.arange(windows, dtype=np.uint64)) & np.uint64(1) > 0
        at, j = np.nonzero(set_ & (np.arange(windows) <= (high - low)[first][:, None]))
        start = low[first[at]] + j
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        return np.cumsum(cover[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in _opened(batches):
            mask, at = gone(chunk, row), 0
            out: dict[str, list] = {n: [] for n in schema.names}
            for i, key, rest, size in zip(chunk.ids.tolist(), chunk.keys, chunk.rests, chunk.sizes.tolist(), strict=True):
                m = mask[at : at + size]
                removed = int(m.sum())
                kept = chunk.t[at : at + size][~m].tobytes() if removed else chunk.body[at : at + size]
                spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if removed else 0
                values = (i, key, rest, size, removed, spans, hashlib.sha256(kept).hexdigest(), (_whole(kept) if removed else kept) if with_text else None)
                for n, v in zip(schema.names, values, strict=True):
                    out[n].append(v)
                at += size
            yield emit(out, schema)

    return chunks.mapInArrow(run, result)


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, with_text: bool = False) -> DataFrame:
    """Per row: __id, __key (of the row's text), n_bytes, n_removed, n_spans, kept_sha256.

    With text also kept (the bytes left) and, in __rest, the row's other columns and whether its text is null: they travel with the
    bodies, so no text is shuffled to join them again.
    """
    if not K < length <= K + 31:
        raise ValueError(f"length must be over {K} and at most {K + 31}")
    check_columns(docs, text, doc_id)
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    others = [F.col(c).alias(f"c{n}") for n, c in enumerate(docs.columns) if c != text] if with_text else []
    rest = F.struct(F.col(text).isNull().alias("empty"), *others)
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LARGEST)).alias("__id"), rest.alias("__rest"), body.alias("__body"))
    given = given.withColumn("__key", F.xxhash64("__body"))
    total = given.agg(F.coalesce(F.sum(F.octet_length("__body").cast("long")), F.lit(0))).first()[0]
    buckets = max(32, -(-total // BUCKET_BYTES))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    chunks = staged(_chunks(given), "chunks")
    shared = staged(_shared(_anchor_lists(chunks, buckets, length), parts), "shared")
    own = shared.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ids", "hot")).alias("shared"))
    with_shared = chunks.repartition(parts, "chunk").join(own, "chunk", "left")
    verdicts = staged(_verdicts(_contexts(with_shared.filter("shared IS NOT NULL"), buckets, length), length, parts), "verdicts")
    judged = verdicts.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("verdicts"))
    return _cut(with_shared.join(judged, "chunk", "left"), buckets, length, with_text)


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = passages(docs, text, doc_id, length)
    return out.select(F.when(F.col("__id") != _LARGEST, F.col("__id")).alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, n_chars: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of their texts (what is left of a cut character goes too), and n_chars, if it is a column, counted anew."""
    found = passages(docs, text, doc_id, length, with_text=True)
    body = F.when(~F.col("__rest.empty"), F.col("kept").cast("string"))

    def column(n: int, name: str) -> Column:
        if name == text:
            return body
        own = F.col(f"__rest.c{n}")
        return F.when(F.col("n_removed") == 0, own).otherwise(F.length(body).cast(docs.schema[n].dataType)) if name == n_chars else own

    return found.select(*[column(n, c).alias(f"c{n}") for n, c in enumerate(docs.columns)]).toDF(*docs.columns)
