"""Exactly one copy of every message.

:func:`drop_repeats` is the plain form. :class:`SeenStore` is the form for deliveries that come in batches: an exact
dictionary gives each identity a dense code, and compressed bitmaps of the codes, in shards, say which have been seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitloom.functions import scalars as X
from remitloom.sources.shared import delete, temporary

_DICTIONARY = "ident string, code bigint, row_id bigint, shard int"
_BITMAPS = "bucket bigint, bits binary, shard int"
_KEPT = "row_id bigint, shard int, code bigint"


def drop_repeats(df: DataFrame, id_column: str, *scope: str) -> DataFrame:
    """One row per (scope, id), any of the copies; rows with a NULL id all stay. For whole results with equal copies."""
    stated = df.filter(F.col(id_column).isNotNull()).dropDuplicates([*scope, id_column])
    return stated.unionByName(df.filter(F.col(id_column).isNull()))


def with_injected_copies(df: DataFrame, matching: Column, copies: int) -> DataFrame:
    """Fault injection: rows that match come ``copies`` times, all others once. A NULL condition doesn't match."""
    times = F.when(matching, F.lit(copies)).otherwise(F.lit(1))
    return df.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).drop("_times")


def message_identity(client: Column, kind: Column, message_id: Column, data_id: Column) -> Column:
    """One text per message: client in any letter case, type, and message id, or data id where there is none.

    Integers agree in any spelling ("007", " 7"), other ids as text. NULL, that is never a repeat, where both ids are
    NULL or the client or the type is.
    """
    client, kind = F.lower(client), kind.cast("string")
    by_message = F.concat_ws("\x01", client, kind, F.lit("m"), X.integer_text(message_id))
    by_data = F.concat_ws("\x01", client, kind, F.lit("d"), X.integer_text(data_id))
    usable = client.isNotNull() & kind.isNotNull()
    return F.when(usable & message_id.isNotNull(), by_message).when(usable & data_id.isNotNull(), by_data)


def shards_for(messages: int, per_shard: int = 2_000_000) -> int:
    """Shards for a store that is to hold about so many messages."""
    return max(8, -(-messages // per_shard))


def _wide(number: int, digits: int) -> Column:
    return F.lit(str(number)).cast(f"decimal({digits},0)")


def arrival_order(rows: DataFrame, at: str, row_id: str) -> Column:
    """(time, row id) as one decimal(38): smaller is earlier, of equal times the smaller id; a NULL time comes last.

    One number of fixed width can be updated in place, so its minimum is a hash aggregate, which a struct's is not. The id
    can be read back with :func:`row_of`.
    """
    t = F.col(at)
    if isinstance(rows.schema[at].dataType, T.TimestampNTZType):  # no time zone takes part
        seconds = F.unix_date(t.cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
        micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    else:
        micros = F.unix_micros(t)
    time = F.coalesce(micros + 10**17, F.lit(10**18 - 1)).cast("decimal(18,0)")
    return time * _wide(10**20, 21) + (F.col(row_id).cast("decimal(20,0)") + _wide(2**63, 20))


def row_of(order: Column) -> Column:
    return (order % _wide(10**20, 21) - _wide(2**63, 20)).cast("bigint")


class SeenStore:
    """Which messages have been seen, over any number of batches.

    Folder layout: ``dictionary/<token>/shard=<n>`` (the identities that got a code in one step), ``bitmaps/<token>/shard=<n>``
    (all bits of a shard, in rows of 32 768, which the file format compresses), ``kept/<token>`` and ``commits/<version>``.
    A commit is a small JSON file: the batch's name, the dictionary's folders, for each shard the codes given out and the
    folder of its bits. A version counts only once its commit exists, and the commit is made by a rename that fails if the
    name is taken: of two writers one wins, the other's folders are deleted and it raises; a job that dies half way leaves
    nothing visible. Codes and bits are committed apart: a code says that an identity is known, its bit that a copy was kept.

    A batch reads and writes only the shards that its identities fall into. ``shards`` bounds the codes one task numbers
    (identities / shards) and is fixed when the store is made; identities are distinct by then, so no shard is hot.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int = 64):
        self.spark, self.folder, self.shards = spark, folder.rstrip("/"), shards
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> dict[int, dict]:
        """Version -> its commit, in order."""
        root = self._path(f"{self.folder}/commits")
        if not self._fs.exists(root):
            return {}
        found = {}
        for x in self._fs.listStatus(root):
            if x.getPath().getName().isdigit():
                stream = self._fs.open(x.getPath())
                found[int(x.getPath().getName())] = json.loads(bytes(stream.readAllBytes()).decode())
                stream.close()
        return dict(sorted(found.items()))

    def _last(self) -> tuple[int, dict]:
        done = self.commits()
        return max(done, default=-1), done[max(done)] if done else {"dictionary": [], "codes": {}, "bits": {}}

    def _read(self, schema: str, folders: list[str], shards: list[int] | None) -> DataFrame:
        """The files of the given shards (all if None); a folder per shard, so others aren't even listed."""
        paths = []
        for folder in folders:
            root = self._path(f"{self.folder}/{folder}")
            have = {int(x.getPath().getName().partition("=")[2]) for x in self._fs.listStatus(root) if x.getPath().getName().startswith("shard=")}
            paths += [(f"{self.folder}/{folder}", n) for n in sorted(have if shards is None else have & set(shards))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = {}
        for base, n in paths:
            parts.setdefault(base, []).append(f"{base}/shard={n}")
        frames = [self.spark.read.schema(schema).option("basePath", base).parquet(*own) for base, own in parts.items()]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def dictionary(self, shards: list[int] | None = None) -> DataFrame:
        """(ident, code, row_id, shard): row_id is the arrival by which the identity became known."""
        return self._read(_DICTIONARY, [f"dictionary/{t}" for t in self._last()[1]["dictionary"]], shards)

    def bitmaps(self, shards: list[int] | None = None) -> DataFrame:
        """(bucket, bits, shard) of the last version."""
        bits = self._last()[1]["bits"]
        by_folder: dict[str, list[int]] = {}
        for shard, token in bits.items():
            if shards is None or int(shard) in shards:
                by_folder.setdefault(token, []).append(int(shard))
        out = self.spark.createDataFrame([], _BITMAPS)
        for token, own in by_folder.items():
            out = out.unionByName(self._read(_BITMAPS, [f"bitmaps/{token}"], own))
        return out

    def encode(self, arrivals: DataFrame) -> DataFrame:
        """(row_id, shard, code): the first arrival of each identity in the batch, with the identity's code.

        Identities that are new get the next codes of their shard, and these are committed at once; no bit is set. Copies
        within the batch are folded before anything moves, so an identity with a third of all rows is one row a task.
        """
        order = arrival_order(arrivals, "at", "row_id")
        shard = F.pmod(F.xxhash64("ident"), F.lit(self.shards)).cast("int")
        first = arrivals.filter(F.col("ident").isNotNull()).groupBy("ident").agg(F.min(order).alias("first"))
        first = temporary(first.select("ident", shard.alias("shard"), row_of(F.col("first")).alias("row_id")), "first")
        touched = [r["shard"] for r in first.df.select("shard").distinct().collect()]  # at most one row per shard
        version, last = self._last()
        token = uuid.uuid4().hex
        known = self.dictionary(touched).select("shard", "ident", "code")
        encoded = temporary(first.df.join(known, ["shard", "ident"], "left"), "encoded") if last["dictionary"] else None
        fresh = encoded.df.filter(F.col("code").isNull()) if encoded else first.df
        given = {int(s): n for s, n in last["codes"].items() if int(s) in touched}
        base = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])[F.col("shard")].cast("bigint") if given else F.lit(None).cast("bigint")
        number = F.row_number().over(Window.partitionBy("shard").orderBy("ident")).cast("bigint")
        coded = fresh.select("ident", (F.coalesce(base, F.lit(0)) + number).alias("code"), "row_id", "shard")
        coded.write.partitionBy("shard").parquet(f"{self.folder}/dictionary/{token}")
        added = {r["shard"]: r["n"] for r in self._read(_DICTIONARY, [f"dictionary/{token}"], None).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        kept = self._read(_DICTIONARY, [f"dictionary/{token}"], None).select("row_id", "shard", "code")
        if added:
            codes = last["codes"] | {str(s): last["codes"].get(str(s), 0) + n for s, n in added.items()}
            self._commit(version + 1, last | {"batch": "", "dictionary": [*last["dictionary"], token], "codes": codes}, token)
        if encoded:
            kept = kept.unionByName(encoded.df.filter(F.col("code").isNotNull()).select("row_id", "shard", "code"))
        first.forget(keep=not encoded)
        return kept

    def ingest(self, arrivals: DataFrame, batch: str = "") -> DataFrame:
        """Takes in one batch (row_id bigint, ident string, at timestamp); returns (row_id) of the copies it keeps.

        ``row_id`` must be unique in the batch. The batch is encoded, and of each code whose bit is not set the arrival with
        the earliest ``at`` is kept, then the smallest ``row_id``; a NULL ``at`` comes last. Where the bit is set nothing is
        kept, so batches should come in order of time. Rows without an identity are not messages and don't come back. The
        new bits are united with those of their shards and committed before the result is returned. A batch with a name
        that is ingested again gets the answer of the first time; without a name its copies count as repeats.
        """
        for done in self.commits().values():
            if batch and done["batch"] == batch:
                return self.spark.read.schema(_KEPT).parquet(f"{self.folder}/kept/{done['kept']}").select("row_id")
        encoded = self.encode(arrivals)
        token, kept_path = uuid.uuid4().hex, self.folder + "/kept/"
        self.unseen(encoded).write.parquet(kept_path + token)
        kept = self.spark.read.schema(_KEPT).parquet(kept_path + token)
        touched = [r["shard"] for r in kept.select("shard").distinct().collect()]  # at most one row per shard
        version, last = self._last()
        bits = kept.groupBy("shard", F.expr("bitmap_bucket_number(code)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(code))").alias("bits"))
        bits = bits.unionByName(self.bitmaps(touched)).groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        bits.repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.folder}/bitmaps/{token}")
        self._commit(version + 1, last | {"batch": batch, "kept": token, "bits": last["bits"] | {str(s): token for s in touched}}, token)
        return kept.select("row_id")

    def unseen(self, encoded: DataFrame) -> DataFrame:
        """Rows of (row_id, shard, code) whose code's bit is not set: an anti join with the bit as its condition."""
        at = F.expr("bitmap_bit_position(code)")
        rows = encoded.select("row_id", "shard", "code", F.expr("bitmap_bucket_number(code)").alias("of_bucket"), at.alias("at"))
        bits = self.bitmaps().select(F.col("shard").alias("of_shard"), "bucket", "bits")
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, (F.col("at") % 8).cast("int")) == 1
        same = (F.col("shard") == F.col("of_shard")) & (F.col("of_bucket") == F.col("bucket")) & is_set
        return rows.join(bits, same, "left_anti").select("row_id", "shard", "code")

    def _commit(self, version: int, commit: dict, token: str) -> None:
        jvm = self.spark.sparkContext._jvm
        staged, final = self._path(f"{self.folder}/staged/{token}"), self._path(f"{self.folder}/commits/{version}")
        stream = self._fs.create(staged, True)
        stream.write(bytearray(json.dumps(commit).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(staged, final, no_overwrite)
        except Exception as error:
            for kind in ("dictionary", "bitmaps", "kept", "staged"):
                delete(self.spark, f"{self.folder}/{kind}/{token}")
            raise RuntimeError(f"version {version} was committed by another writer") from error


def ingest_in_order(store: SeenStore, arrivals: DataFrame, slices: int = 2) -> DataFrame:
    """(row_id) of the copies kept of a whole table, taken in as ``slices`` batches in order of ``at``.

    Which copy of a message stays depends on the time over all batches, while a store keeps what it kept: so the batches
    are cut by time and not by the order of arrival. A message's bit is then set by its earliest copy, and nothing has to be
    revised later. The cuts are percentiles, so the slices are about even; rows without a time come last.
    """
    shares = [i / slices for i in range(1, slices)]
    cuts = arrivals.agg(F.percentile_approx("at", shares, 200).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    kept = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if low is None else F.col("at") >= F.lit(low).cast(arrivals.schema["at"].dataType)
        if high is not None:
            part = part & (F.col("at") < F.lit(high).cast(arrivals.schema["at"].dataType))
        else:
            part = part | F.col("at").isNull()
        one = store.ingest(arrivals.filter(part))
        kept = one if kept is None else kept.unionByName(one)
    return kept


def surplus(arrivals: DataFrame, kept: DataFrame) -> DataFrame:
    """(row_id) of the arrivals with an identity that are not kept; an anti join on unique ids, so no key is hot."""
    return arrivals.filter(F.col("ident").isNotNull()).select("row_id").join(kept, "row_id", "left_anti")
