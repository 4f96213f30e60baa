"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of a prime number of slots (offset and skip
from its name's MD5). Shards take turns, and at its turn a shard claims the first
slot of its permutation that is still free, until none is free. So shards own
equal numbers of slots to within one, and if a shard leaves, few slots of the
others change hands. A key's slot is its MD5 modulo the number of slots; its shard is one
probe of the broadcast table, whose size is fixed by a parameter.

The table is filled once on the driver: it has as many entries as there are
slots, whatever the input. Placing rows uses DataFrame functions alone and needs
no shuffle.

Defined cases: rows with equal keys go to one shard; a null key is the key of the
empty string; an empty table gives an empty result; other columns are kept as they
are, or dropped where they clash with the columns added here.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import id_text, md5_long, table

SLOTS = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not _is_prime(slots) or slots < max(1, len(shards)):
        raise ValueError("slots must be a prime number and at least the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    at = [int(d[:15], 16) % slots for d in digests]
    skip = [int(d[15:30], 16) % (slots - 1) + 1 if slots > 1 else 0 for d in digests]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def lookup_frame(spark: SparkSession, owners: Sequence[int], name: str) -> DataFrame:
    """(slot, name) with a row for each slot, from one literal."""
    listed = F.from_json(F.lit(json.dumps(list(owners))), "array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", name))


def place(df: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot, shard, and shard_after: the shard if the last of the shards left."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("slot", "shard", "shard_after")]
    now, after = lookup_table(shards, slots), lookup_table(shards[:-1] or shards, slots)
    tables = lookup_frame(spark, now, "shard").join(lookup_frame(spark, after, "shard_after"), "slot")
    keyed = df.withColumn("slot", (md5_long(id_text(key_col)) % slots).cast("int")).select(*kept, "slot")
    return keyed.join(F.broadcast(tables), "slot").select(*kept, "slot", "shard", "shard_after")


def write_shards(df: DataFrame, key_col: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, files_per_shard: int = 8) -> None:
    """Parquet files under path/shard=N; rows of a shard are dealt to several tasks, so no shard and no key has to fit in one."""
    placed = place(df, key_col, shards, slots)
    salt = F.pmod(F.xxhash64(*[placed[c] for c in placed.columns if c != "shard"]) + F.spark_partition_id(), F.lit(files_per_shard))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(docs, "doc_id").select("doc_id", "slot", "shard", "shard_after")


def op7_sql() -> str:
    now, after = lookup_table(), lookup_table(SHARDS[:-1])
    return f"""
WITH placed AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents),
owners AS (SELECT {now} AS now_at, {after} AS after_at)
SELECT doc_id, slot, now_at[slot + 1]::INTEGER AS shard, after_at[slot + 1]::INTEGER AS shard_after FROM placed, owners
"""
