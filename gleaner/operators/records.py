"""Write patterns as new versions of tables: conformed inserts, updates by id, marks, migration, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import collapsed
from gleaner.operators.common import insert_absent, top_k


def conformed(rows: DataFrame, schema: str, lists: tuple[str, ...] = (), trimmed: tuple[str, ...] = (), zeros: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns of a record table, in its order and types: list columns as JSON text, trimmed texts, nulls of zeros as 0, absent columns null."""
    from pyspark.sql.types import StructType

    def one(name: str, kind: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name)
        c = F.to_json(c) if name in lists else F.trim(c) if name in trimmed else c
        c = F.coalesce(c, F.lit(0)) if name in zeros else c
        return c.cast(kind).alias(name)

    return rows.select(*[one(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields])


def updated(table: DataFrame, changes: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """table with the columns of the rows that changes names (one change per key, of one column or several) taken from there; nulls in changes leave a value as it is."""
    new = changes.select(*([key] if isinstance(key, str) else key), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def stored(items: DataFrame, artifacts: DataFrame, text: str, item: str, least: int = 200, source_id: int = 2) -> DataFrame:
    """(item, artifact_id, is_new, source_id) for feed items stored on demand: those long enough, under the id of the artifact with the same content if there is one.

    Items of one content are one new artifact, under the smallest item's id.
    """
    from gleaner.functions.text import content_hash

    long = items.filter(F.length(collapsed(F.col(text))) >= least).withColumn("content_hash", content_hash(F.col(text)))
    known = artifacts.groupBy("content_hash").agg(F.min("artifact_id").alias("known"))
    first = long.groupBy("content_hash").agg(F.min(item).alias("first"))
    out = long.join(first, "content_hash").join(known, "content_hash", "left")
    return out.select(item, F.coalesce("known", "first").alias("artifact_id"), F.col("known").isNull().alias("is_new"), F.lit(source_id).alias("source_id"))


def attached(ledger: DataFrame, new: DataFrame, key: str, entry: str, column: str) -> DataFrame:
    """The ledger with new(key, column) written to each key's newest entry, or, where it has none, to an entry of its own (0)."""
    newest = ledger.groupBy(key).agg(F.max(entry).alias("__newest"))
    joined = ledger.join(newest, key).join(new.select(key, F.col(column).alias("__new")), key, "left")
    kept = joined.select(key, entry, F.when((F.col(entry) == F.col("__newest")) & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(column)).alias(column))
    added = new.join(ledger.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast(ledger.schema[entry].dataType).alias(entry), column)
    return kept.unionByName(added)


def reverted(ledger: DataFrame, problems: DataFrame, marked: DataFrame, key: str, day: str, today: Column) -> tuple[DataFrame, DataFrame]:
    """Publish marks taken back: the ledger without today's entries of the marked keys, and the problems with those set to ready."""
    gone = ledger.filter(F.col(day) == today).join(marked, key, "left_semi")
    left = ledger.join(gone.select(key).distinct().withColumn(day, today), [key, day], "left_anti")
    back = gone.select(key).distinct().withColumn("status", F.lit("ready"))
    return left, updated(problems, back, key, ["status"])


def migrated(old: DataFrame, schema: str, flagged: Column, note: str) -> DataFrame:
    """Rows of an old table in a new schema: new columns are null, and the quality of flagged rows becomes the note."""
    out = conformed(old.withColumn("quality", F.when(flagged, F.lit(note)).otherwise(F.col("quality"))) if "quality" in old.columns else old.withColumn("quality", F.when(flagged, F.lit(note))), schema)
    return out


def get_or_create(new: DataFrame, old: DataFrame, keys: list[str], key_id: str) -> DataFrame:
    """Each row of new with the id of the old row that has its keys, or of the first new row with them; and whether it is created."""
    ids = old.groupBy(*keys).agg(F.min(key_id).alias("__old"))
    fresh = new.groupBy(*keys).agg(F.min(key_id).alias("__first"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    n, f, i = new.alias("n"), fresh.alias("f"), ids.alias("i")
    joined = n.join(f, [F.col(f"n.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]).join(i, [F.col(f"n.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], "left")
    return joined.select(*[F.col(f"n.{c}") for c in new.columns], F.coalesce("i.__old", "f.__first").alias("record_id"), (F.col("i.__old").isNull() & (F.col(f"n.{key_id}") == F.col("f.__first"))).alias("created"))


def linked_once(links: DataFrame, old: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-ignore of links: old, and the first of the new ones per keys that old lacks."""
    return old.unionByName(insert_absent(links, old, keys, order))


def backfilled(measurements: DataFrame, resolved: DataFrame, key: str | list[str]) -> DataFrame:
    """Measurements with the subject's entity filled in where it is null and a resolution is known; key: what tells measurements apart, one column or several."""
    return updated(measurements.filter("entity_id IS NULL"), resolved, key, ["entity_id"]).unionByName(measurements.filter("entity_id IS NOT NULL"))


def appended(snapshots: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots with fresh readings behind; a reading of a day that is there already isn't taken again."""
    return snapshots.unionByName(fresh.join(snapshots.select(*keys), keys, "left_anti"))


def newest_versions(posts: DataFrame, key: str, version: list[str]) -> DataFrame:
    return top_k(posts, [key], [F.desc(v) for v in version], 1)


def recent_items(ledger: DataFrame, keys: list[str], entry: list[str], item: str, most: int = 40) -> DataFrame:
    """(keys, item, place): a ledger's items from the newest entry backwards, each once, the first so many."""
    last = ledger.groupBy(*keys, item).agg(F.max(F.struct(*entry)).alias("__at"))
    return top_k(last, keys, [F.desc("__at"), F.asc(item)], most, "place").select(*keys, item, "place")


def cartesian_links(questions: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """Every chosen piece of evidence to every question of its problem: the pairs that are wanted, met by the problem."""
    return questions.join(chosen, group)
