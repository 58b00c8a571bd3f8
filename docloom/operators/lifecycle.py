"""Lifecycle: approval states, versioned stages, locks, leases and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import cron_matches

#: Thresholds of the review tests (fixed values).
MAX_DATES, MAX_YEARS_BACK, MAX_YEARS_AHEAD = 10, 5, 1
MAX_ADDED, MAX_REMOVED, MAX_EDITED = 0.10, 0.05, 0.10


def hold_reasons(confidence: Column, threshold: Column, effective: Column, n_dates: Column, lineage_confidence: Column, now: Column) -> Column:
    """The reasons to hold a classification, in order; an empty array for none."""
    outside = effective.isNull() | (effective < F.add_months(now, -12 * MAX_YEARS_BACK)) | (effective > F.add_months(now, 12 * MAX_YEARS_AHEAD))
    tests = {
        "DOC_TYPE": F.coalesce(confidence < threshold, F.lit(True)),
        "EFFECTIVE_DATE": outside,
        "IDENTIFIED_DATES": F.coalesce(n_dates > MAX_DATES, F.lit(False)),
        "LINEAGE": F.coalesce(lineage_confidence < 1, F.lit(False)),
    }
    return F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())


def assessed(status: Column, holds: Column) -> Column:
    """A pending step is queued if anything holds it, else approved; any other state stays."""
    return F.when(status != "PENDING", status).when(F.size(holds) > 0, "QUEUED").otherwise("APPROVED")


def overall(*steps: Column) -> Column:
    """APPROVED if all steps are, else QUEUED if one is, else PENDING."""
    states = F.array(*steps)
    return F.when(F.forall(states, lambda s: s == "APPROVED"), "APPROVED").when(F.exists(states, lambda s: s == "QUEUED"), "QUEUED").otherwise("PENDING")


def needs_extraction_review(added: Column, removed: Column, edited: Column, total: Column) -> Column:
    """Whether too great a share of rows was added, removed or edited."""
    return F.coalesce((added > total * MAX_ADDED) | (removed > total * MAX_REMOVED) | (edited > total * MAX_EDITED), F.lit(False))


def stale_stages(own: Column, versions: dict[str, str]) -> Column:
    """The stages to run again: all if the content's version is old; a new document type asks for tags too.

    ``own`` is a struct of the versions a document was processed with; ``versions`` has the present ones in order.
    """
    old = {name: ~own[name].eqNullSafe(F.lit(v)) for name, v in versions.items()}
    due = {
        "content": old["content"],
        "date": old["content"] | old["date"],
        "doc_type": old["content"] | old["doc_type"],
        "tag": old["content"] | old["doc_type"] | old["tag"],
    }
    return F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in due.items()]), lambda x: x.isNotNull())


def with_lock(locks: Column, queue: str, user: str, now: Column, expires: Column) -> Column:
    """``locks`` after a user's attempt on a queue: expired ones go; one's own is extended; a free one is taken."""
    live = F.filter(locks, lambda x: x["expires"] > now)
    others = F.filter(live, lambda x: ~((x["queue"] == queue) & (x["user"] == user)))
    free = ~F.exists(others, lambda x: x["queue"] == queue)
    mine = F.struct(F.lit(queue).alias("queue"), F.lit(user).alias("user"), expires.alias("expires"))
    return F.when(free, F.array_append(others, mine)).otherwise(others)


def take_next(items: DataFrame, queue: str, now: Column, order: list[Column]) -> DataFrame:
    """The first item in the queue's order that no live lock holds."""
    held = F.exists("locks", lambda x: (x["queue"] == queue) & (x["expires"] > now))
    return items.where(~F.coalesce(held, F.lit(False))).orderBy(*order).limit(1)


def eligible_sites(sites: DataFrame, running: DataFrame, now: Column, min_hours: int = 0) -> DataFrame:
    """Sites to collect at ``now``: enabled, automatic, with an active url, due by cron, not held and not running."""
    due = (
        cron_matches(F.col("cron"), now)
        & ~F.coalesce(F.col("disabled"), F.lit(False))
        & (F.col("method") == "AUTOMATED")
        & F.exists("urls", lambda u: u["status"] == "ACTIVE")
        & (F.col("hold").isNull() | (F.col("hold") < now))
        & (F.col("last_run").isNull() | (F.col("last_run") <= now - F.make_dt_interval(F.lit(0), F.lit(min_hours))))
    )
    return sites.where(due).join(running.select("site_id").distinct(), "site_id", "left_anti")


def silent_tasks(tasks: DataFrame, now: Column, minutes: int, seen: str) -> DataFrame:
    """Tasks in progress that were last seen more than some minutes ago, or never."""
    limit = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return tasks.where((F.col("status") == "IN_PROGRESS") & (F.col(seen).isNull() | (F.col(seen) < limit)))


def requeued(tasks: DataFrame, attempts: int = 5) -> DataFrame:
    """Hung tasks after the check: canceling ones are canceled, those of too many attempts fail, the rest queue again."""
    status = F.when(F.col("status") == "CANCELING", "CANCELED").when(F.col("attempts") >= attempts, "FAILED").otherwise("QUEUED")
    return tasks.withColumn("status", status)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` over those of the same key; changed fields that are null keep the old value."""
    old = table.select(F.col(key).alias("_key"), F.struct(*table.columns).alias("_old"))
    new = changes.select(F.col(key), F.struct(*changes.columns).alias("_new"))
    both = new.join(old, F.col(key) == F.col("_key"), "full")
    pick = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in changes.columns else F.col(f"_old.{c}")
    return both.select(*[pick(c).alias(c) for c in table.columns])


def first_seen(df: DataFrame, url: str, digest: str, order: str) -> DataFrame:
    """Rows whose url is new, or whose digest is, in their order of arrival."""
    from pyspark.sql import Window

    new_url = F.row_number().over(Window.partitionBy(url).orderBy(order)) == 1
    new_digest = F.row_number().over(Window.partitionBy(digest).orderBy(order)) == 1
    return df.withColumn("_u", new_url).withColumn("_d", new_digest).where("_u OR _d").drop("_u", "_d")
