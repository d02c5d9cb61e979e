"""Many patterns in many texts: an automaton over all patterns, built once and run over Arrow batches of texts.

Patterns of at most BLOCK_BYTES make one automaton, which goes to the tasks as a broadcast. More patterns are dealt into as many blocks as their
bytes need, and the texts are read once for each block; the driver holds one block at a time. Each text is walked once per block, however many patterns there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton, which takes some forty times as much memory.
BLOCK_BYTES = 2 << 20


def _found(texts: DataFrame, patterns: list, around: int) -> DataFrame:
    import ahocorasick

    built = ahocorasick.Automaton()
    of: dict[str, list[tuple[str, int]]] = {}
    for pattern, name, rank in patterns:
        of.setdefault(pattern, []).append((name, rank))
    for pattern, names in of.items():
        built.add_word(pattern, (pattern, names))
    built.make_automaton()
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(built))
    key = texts.schema[0]
    schema = f"`{key.name}` {key.dataType.simpleString()}, name string, rank int, at int, near string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(sent.value)
        for batch in batches:
            rows, kinds = [], batch.schema.field(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best: dict[str, tuple[int, int, int]] = {}
                for end, (pattern, names) in automaton.iter(text or "") if of else ():
                    start = end - len(pattern) + 1
                    for name, rank in names:
                        if name not in best or (rank, start) < best[name][:2]:
                            best[name] = (rank, start, end)
                rows += [(k, name, rank, start + 1, text[max(0, start - around) : end + 1 + around]) for name, (rank, start, end) in best.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kinds, pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=[key.name, "name", "rank", "at", "near"])

    return texts.mapInArrow(run, schema)


def found(texts: DataFrame, patterns: DataFrame, key: str, text: str, around: int = 40) -> DataFrame:
    """(key, name, rank, at, near): for each row of texts and each name the first place of its best-ranked pattern that the text holds, with what stands around it.

    patterns: pattern, name, rank; a name may have several patterns, the lowest rank is best. Null and empty patterns are never found.
    """
    used = patterns.select("pattern", "name", F.col("rank").cast("int").alias("rank")).filter(F.length("pattern") > 0).distinct()
    size = used.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    given = texts.select(key, text)
    # a name's patterns share a block, so that the best of them is told there
    parts = [_found(given, [tuple(r) for r in used.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).collect()], around) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
