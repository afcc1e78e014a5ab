"""Upsert sink: a keyed image kept by a stream of changes.

Each micro-batch is reduced to its last row per key and written as one numbered change folder,
so a batch costs its own size and not the image's. Every ``compact_every`` batches the changes
are folded into a snapshot. Readers merge the newest snapshot with the changes after it.
Re-running a batch number rewrites the same folders, so the image is unchanged. A snapshot
makes everything before the last one superfluous, and that is removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtables.operators.versions import keep_last
from streamtables.streaming.files import committed, folder_names, make_folder, read_numbered, remove, write_numbered

BATCH = "_batch"
DELETED = "_deleted"


@dataclass
class UpsertSink:
    """``order`` decides between rows of one key in one batch. Across batches the later batch
    wins, as in a changelog topic; with ``by_order`` the order columns win everywhere, so that
    out-of-order replays give the same image. ``deleted`` marks rows that remove their key.
    ``keep_changes`` leaves old change folders, for a stream that reads them as messages."""

    path: str
    key: list[str]
    order: list[str]
    deleted: Column | None = None
    by_order: bool = False
    compact_every: int = 20
    keep_changes: bool = False

    @property
    def _changes(self) -> str:
        return f"{self.path}/changes"

    @property
    def _snapshots(self) -> str:
        return f"{self.path}/snapshots"

    @property
    def _pins(self) -> str:
        return f"{self.path}/pins"

    def precedence(self) -> list[str]:
        """What makes a row of a key newer than another."""
        return [*self.order, BATCH] if self.by_order else [BATCH, *self.order]

    def marked(self, batch: DataFrame, number: int) -> DataFrame:
        """The last row per key of a batch, with its number and whether it removes the key."""
        deleted = F.lit(False) if self.deleted is None else F.coalesce(self.deleted, F.lit(False))
        marked = batch.withColumn(DELETED, deleted).withColumn(BATCH, F.lit(number).cast("long"))
        return keep_last(marked, self.key, self.order or [BATCH])

    def write(self, batch: DataFrame, number: int) -> None:
        """Write one batch; usable as the function of ``foreachBatch``."""
        write_numbered(self.marked(batch, number), self._changes, number)
        if number and number % self.compact_every == 0:
            self.compact(batch.sparkSession, number)

    def _merged(self, spark: SparkSession, upto: int | None = None, below: int | None = None) -> DataFrame | None:
        """Last row per key, removed keys included, from a snapshot and the changes after it."""
        limit = min(float("inf") if below is None else below - 1, float("inf") if upto is None else upto)
        snapshots = [n for n in committed(spark, self._snapshots) if n <= limit]
        base = snapshots[-1] if snapshots else -1
        numbers = [n for n in committed(spark, self._changes) if n > base and (upto is None or n <= upto)]
        parts = [read_numbered(spark, self._snapshots, [base])] if snapshots else []
        parts += [read_numbered(spark, self._changes, numbers)] if numbers else []
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return keep_last(rows, self.key, self.precedence())

    def below(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The image before a batch, with removed keys and marks; None if nothing was written."""
        return self._merged(spark, upto=number - 1, below=number)

    def compact(self, spark: SparkSession, number: int) -> None:
        """Fold all changes up to ``number`` into a snapshot. Removed keys stay as markers."""
        write_numbered(self._merged(spark, upto=number, below=number), self._snapshots, number)
        # The last snapshot and what followed it stay for readers that have begun, and so does
        # what a pinned image is made of.
        snapshots = committed(spark, self._snapshots)
        base = lambda image: max((n for n in snapshots if n <= image), default=-1)
        last = base(number - 1)
        needed = {image: base(image) for pins in self._pinned(spark).values() for image in pins.values()}
        for n in snapshots:
            if n < last and n not in needed.values():
                remove(spark, f"{self._snapshots}/b={n}")
        for n in committed(spark, self._changes):
            if n <= last and not self.keep_changes and not any(b < n <= i for i, b in needed.items()):
                remove(spark, f"{self._changes}/b={n}")

    def image(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The current image, or that after batch ``upto``."""
        merged = self._merged(spark, upto)
        if merged is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        return merged.filter(~F.col(DELETED)).drop(DELETED, BATCH)

    # -- readers that come again ----------------------------------------------------------

    def _pinned(self, spark: SparkSession) -> dict[str, dict[int, int]]:
        """Per reader, the image that each of its batches reads."""
        pins: dict[str, dict[int, int]] = {}
        for name in folder_names(spark, f"{self._pins}/*"):
            reader, batch, image = name.rsplit("-", 2)
            pins.setdefault(reader, {})[int(batch)] = int(image)
        return pins

    def pinned_image(self, spark: SparkSession, reader: str, number: int) -> DataFrame:
        """The image for batch ``number`` of a reader: the current one when the batch begins.

        A batch that is repeated reads the same image again. What it is made of is kept until
        the reader has come to the batch after the next.
        """
        pins = self._pinned(spark).get(reader, {})
        if number not in pins:
            pins[number] = max(committed(spark, self._changes), default=-1)
            if pins[number] < 0:
                raise ValueError(f"nothing was written to {self.path} yet")
            make_folder(spark, f"{self._pins}/{reader}-{number}-{pins[number]}")
        for batch, image in pins.items():
            if batch < number - 1:
                remove(spark, f"{self._pins}/{reader}-{batch}-{image}")
        return self.image(spark, pins[number])
