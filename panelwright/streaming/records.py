"""One row per key, kept up to date by a stream's batches, as plain Parquet folders.

A batch writes its own rows to a folder of its own and nothing else, so its cost does not grow
with the table. Reading merges the folders not yet folded in. A separate job folds them into
hash buckets: it rewrites only the buckets that have news, as a new generation beside the old,
and a marker written last makes them count. Once the buckets have grown, their number doubles
(by the next bit of the hash), which rewrites all of them, ever more seldom.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows that a bucket should hold, and bits of the hash that a new table starts with.
BUCKET_ROWS, FIRST_BITS = 1_000_000, 3


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_records(
    current: DataFrame | None, updates: DataFrame, key: str = "id", tie: str | None = None
) -> DataFrame:
    """One row per key, whatever the batches: the newest by ``updated_at`` over table and
    updates, with the earliest ``created_at`` of them all.

    Of rows equally new the one with the greater ``tie`` wins, then the one with the greater
    content hash, so the order in which batches arrive makes no difference.
    """
    rows = updates if current is None else current.unionByName(updates.select(*current.columns))
    content = F.xxhash64(*[F.col(c) for c in sorted(rows.columns) if c != "created_at"])
    ties = [F.desc_nulls_last(tie)] if tie else []
    newest = latest_per_key(rows, key, [F.desc_nulls_last("updated_at"), *ties, content.desc()])
    created = rows.groupBy(F.col(key).alias("_key")).agg(F.min("created_at").alias("_created"))
    joined = newest.join(created, newest[key].eqNullSafe(created["_key"]), "left")
    return joined.withColumn("created_at", F.col("_created")).select(*newest.columns)


class RecordTable:
    """Records under ``path``: ``batch-<id>`` folders, buckets, and ``folded-<id>-<bits>`` markers.

    A marker says that batches up to its id are in the buckets of that many bits.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", tie: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.key, self.tie, self.bucket_rows = spark, path.rstrip("/"), key, tie, bucket_rows

    # -- the store -----------------------------------------------------------------------

    def _store(self, name: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target, target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str = "") -> list[str]:
        target, store = self._store(folder)
        if not store.exists(target):
            return []
        return [entry.getPath().getName() for entry in store.listStatus(target)]

    def _delete(self, name: str) -> None:
        target, store = self._store(name)
        store.delete(target, True)

    def _whole(self, name: str) -> bool:
        target, store = self._store(f"{name}/_SUCCESS")
        return store.exists(target)

    def _state(self) -> tuple[int, int | None, list[int]]:
        """Last batch in the buckets, the buckets' bits, and the batches not in them yet."""
        names = self._names()
        if any(n.endswith(".parquet") for n in names):
            raise ValueError(f"{self.path} is not a table of records: it has files of its own")
        marks = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("folded-")]
        upto, bits = max(marks, default=(-1, None))
        waiting = sorted(int(n.split("-")[1]) for n in names if n.startswith("batch-"))
        return upto, bits, [b for b in waiting if b > upto and self._whole(f"batch-{b}")]

    def _generations(self, bits: int, upto: int) -> dict[int, int]:
        """Newest generation of each bucket that counts."""
        found: dict[int, int] = {}
        for folder in self._names(f"bits-{bits}"):
            if folder.startswith("upto="):
                at = int(folder.split("=")[1])
                for inner in self._names(f"bits-{bits}/{folder}") if at <= upto else []:
                    if inner.startswith("bucket="):
                        b = int(inner.split("=")[1])
                        found[b] = max(at, found.get(b, -1))
        return found

    def _buckets(self, bits: int, upto: int, only: set[int] | None = None) -> DataFrame | None:
        own = {b: at for b, at in self._generations(bits, upto).items() if only is None or b in only}
        if not own:
            return None
        paths = [f"{self.path}/bits-{bits}/upto={at}/bucket={b}" for b, at in sorted(own.items())]
        return self.spark.read.parquet(*paths)

    def _batches(self, ids: Sequence[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/batch-{b}" for b in ids]) if ids else None

    # -- what users call -------------------------------------------------------------------

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a batch; the same id again replaces it, unless it is in the buckets already."""
        if batch_id <= self._state()[0]:
            return
        merge_records(None, batch, self.key, self.tie).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")

    def read(self) -> DataFrame | None:
        """One row per key over buckets and waiting batches; None before the first batch."""
        upto, bits, waiting = self._state()
        current = self._buckets(bits, upto) if bits is not None else None
        news = self._batches(waiting)
        if news is None:
            return current
        return merge_records(current, news, self.key, self.tie)

    def fold(self) -> bool:
        """Brings the waiting batches into the buckets; False if there are none.

        Stopped at any point it can be run again: folders without their marker don't count.
        """
        upto, bits, waiting = self._state()
        if not waiting:
            return False
        news, last = self._batches(waiting), waiting[-1]
        wanted = FIRST_BITS if bits is None else bits
        total = news.count() + (0 if bits is None else self._buckets(bits, upto).count())
        while total > self.bucket_rows << wanted:
            wanted += 1
        bucket = lambda n: F.pmod(F.xxhash64(self.key), F.lit(1 << n)).cast("int")
        current = None
        if bits is not None:
            touched = None if wanted != bits else {r[0] for r in news.select(bucket(bits)).distinct().collect()}
            current = self._buckets(bits, upto, touched)
        merged = merge_records(current, news, self.key, self.tie).withColumn("bucket", bucket(wanted))
        out = f"bits-{wanted}/upto={last}"
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{out}")
        target, store = self._store(f"folded-{last}-{wanted}")
        store.create(target, True).close()
        return True

    def clean(self) -> None:
        """Deletes what no reader that starts now would read."""
        upto, bits, _ = self._state()
        if bits is None:
            return
        live = self._generations(bits, upto)
        for name in self._names():
            kind, _, rest = name.partition("-")
            if (kind == "batch" and int(rest) <= upto) or (kind == "bits" and int(rest) != bits) or (
                    kind == "folded" and rest != f"{upto}-{bits}"):
                self._delete(name)
        for folder in self._names(f"bits-{bits}"):
            at = int(folder.split("=")[1]) if folder.startswith("upto=") else None
            for inner in self._names(f"bits-{bits}/{folder}") if at is not None else []:
                if inner.startswith("bucket=") and live.get(int(inner.split("=")[1])) != at:
                    self._delete(f"bits-{bits}/{folder}/{inner}")


def upsert_sink(
    spark: SparkSession, table_path: str, key: str = "id", tie: str | None = None, fold_every: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps one row per key under ``table_path``.

    A batch only adds its rows; with ``fold_every`` each so many batches are folded in as well,
    otherwise a job of its own calls :meth:`RecordTable.fold`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = RecordTable(batch.sparkSession, table_path, key, tie, bucket_rows)
        table.write(batch, batch_id)
        if fold_every and (batch_id + 1) % fold_every == 0:
            table.fold()

    return write
