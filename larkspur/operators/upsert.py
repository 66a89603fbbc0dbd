"""Pages keyed by address: what an incoming batch does to the stored ones, which dependants go with them, and a store that
does it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.segments import SegmentStore

PAGES = "final_url string, title string, text string, content_hash string, status int, created_at timestamp_ntz, updated_at timestamp_ntz, last_seen_at timestamp_ntz, content_version bigint, version bigint"


def upsert_status(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(final_url, status): inserted, updated, unchanged, or kept for stored pages that the batch doesn't name. Both sides
    are (final_url, content_hash), one row an address; null addresses are left out. A hash that is null on both sides is
    unchanged."""
    s = stored.where("final_url is not null").select("final_url", F.col("content_hash").alias("old"), F.lit(1).alias("s"))
    i = incoming.where("final_url is not null").select("final_url", F.col("content_hash").alias("new"), F.lit(1).alias("i"))
    status = F.when(F.col("i").isNull(), "kept").when(F.col("s").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return s.join(i, "final_url", "full").select("final_url", status.alias("status"))


def surviving(dependants: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the changed ones: a cascading delete."""
    return dependants.join(changed.select(key).distinct(), key, "left_anti")


class PageStore(SegmentStore):
    """Pages and what is made of their texts, as logs of segments.

    A batch appends the pages that it names: new content with its dependants, or, where the content hash is the same, the
    page's metadata with a new ``last_seen_at`` and an unmoved ``updated_at``. Dependants carry the version in which their
    page's content was written, so replacing a page drops its former ones without a write, and both show at once.
    """

    TABLES = ("pages", "dependants")

    def __init__(self, spark, path: str, derive: Callable[[DataFrame], DataFrame], dependants: str, fan: int = 8):
        """``derive`` makes dependants (final_url, ...) of pages (final_url, title, text); ``dependants`` is their schema."""
        super().__init__(spark, path, fan)
        self.derive, self.schema = derive, f"{dependants}, content_version bigint"

    def _latest(self, segments: list) -> DataFrame:
        rows = self.read(segments, PAGES)
        rest = [c for c in rows.columns if c != "final_url"]
        return rows.groupBy("final_url").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("final_url", "v.*")

    def pages(self) -> DataFrame:
        """The present pages, one row an address."""
        return self._latest(self.manifest()["pages"])

    def dependants(self) -> DataFrame:
        """The dependants of the pages' present contents."""
        m = self.manifest()
        now = self._latest(m["pages"]).select("final_url", "content_version")
        return self.read(m["dependants"], self.schema).join(now, ["final_url", "content_version"], "left_semi").drop("content_version")

    def apply(self, incoming: DataFrame) -> DataFrame:
        """Take in one batch (final_url, title, text, content_hash, status, seen_at) and give (final_url, status) of its
        pages. Of several rows of an address the one seen last counts; null addresses are left out. A batch that is
        applied again changes nothing but what ``last_seen_at`` says already."""
        old = self.manifest()
        number, dropped = old["version"] + 1, []
        self.claim(number)
        cols = ["title", "text", "content_hash", "status", "seen_at"]
        batch = incoming.where("final_url is not null").groupBy("final_url").agg(F.max(F.struct("seen_at", *(c for c in cols if c != "seen_at"))).alias("v")).select("final_url", *(f"v.{c}" for c in cols))
        known = self._latest(old["pages"]).select("final_url", F.col("content_hash").alias("old_hash"), "created_at", "updated_at", "last_seen_at", "content_version", F.lit(True).alias("known"))
        both = batch.join(known, "final_url", "left")
        same = F.coalesce("known", F.lit(False)) & F.col("content_hash").eqNullSafe(F.col("old_hash"))
        rows = both.select(
            "final_url", "title", "text", "content_hash", "status", F.coalesce("created_at", "seen_at").alias("created_at"), F.when(same, F.col("updated_at")).otherwise(F.col("seen_at")).alias("updated_at"),
            F.greatest("seen_at", "last_seen_at").alias("last_seen_at"), F.when(same, F.col("content_version")).otherwise(F.lit(number)).cast("bigint").alias("content_version"), F.lit(number).cast("bigint").alias("version"),
            F.when(same, "unchanged").when(F.col("known"), "updated").otherwise("inserted").alias("change"),
        )
        folder = self.write(rows, "pages")
        written = self.spark.read.schema(f"{PAGES}, change string").parquet(folder)
        fresh = written.where("change <> 'unchanged'").select("final_url", "title", "text")
        made = self.write(self.derive(fresh).withColumn("content_version", F.lit(number).cast("bigint")), "dependants")
        pages = self.merged([*old["pages"], [0, folder]], "pages", dropped, lambda last, _: self._latest(last))
        now = self._latest(pages).select("final_url", "content_version")
        kept = self.merged([*old["dependants"], [0, made]], "dependants", dropped, lambda last, _: self.read(last, self.schema).join(now, ["final_url", "content_version"], "left_semi"))
        self.publish({"version": number, "pages": pages, "dependants": kept, "dropped": [f for f in dropped if f != folder]}, old)
        return written.select("final_url", F.col("change").alias("status"))

    def mark_seen(self, seen: DataFrame) -> None:
        """Touch ``last_seen_at`` of pages (final_url, seen_at). An address that isn't stored is an error, and nothing is
        touched then."""
        old = self.manifest()
        number, dropped = old["version"] + 1, []
        asked = seen.where("final_url is not null").groupBy("final_url").agg(F.max("seen_at").alias("seen_at"))
        stored = self._latest(old["pages"])
        unknown = asked.join(stored, "final_url", "left_anti").first()
        if unknown:
            raise KeyError(unknown["final_url"])
        self.claim(number)
        touched = stored.join(asked, "final_url").withColumns({"last_seen_at": F.greatest("last_seen_at", "seen_at"), "version": F.lit(number).cast("bigint")}).drop("seen_at")
        pages = self.merged([*old["pages"], [0, self.write(touched, "pages")]], "pages", dropped, lambda last, _: self._latest(last))
        self.publish(old | {"version": number, "pages": pages, "dropped": dropped}, old)
