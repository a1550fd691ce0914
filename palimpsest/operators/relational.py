"""Filters, joins, aggregates and ranks over rows, each a plan that Spark optimises; nothing is gathered but short lists.

Unless said otherwise a null in a compared column leaves the row out, ties go to the smaller id, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .memory import age, clock


def scoped(rows: DataFrame, user: int, space: int | None = None) -> DataFrame:
    """One tenant's rows, of one space if given."""
    own = rows.filter(F.col("user_id") == user)
    return own if space is None else own.filter(F.col("space_id") == space)


def matching(rows: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """Rows that hold a string in one of the columns, without regard to case."""
    return rows.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(part.lower())) for c in columns]))


def equal_nocase(rows: DataFrame, **equal: str) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a & b, [F.lower(c) == v.lower() for c, v in equal.items()]))


def expired(rows: DataFrame, as_of: str, column: str) -> DataFrame:
    return rows.filter(F.col(column) <= clock(as_of))


def to_reconsolidate(rows: DataFrame, as_of: str) -> DataFrame:
    """Rows of low adaptive score, more often missed than hit, or old and unstable."""
    low, missed = F.col("adaptive_score") < 0.3, (F.col("access_count") > 5) & (F.col("recall_misses") > F.col("recall_hits"))
    return rows.filter(F.coalesce(low, F.lit(False)) | missed | ((age(as_of) > 7) & (F.col("fsrs_stability") < 1.0)))


def hot(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows read in so many days, or written then if they were never read."""
    return rows.filter(scores.days_between(F.coalesce("last_accessed_at", "created_at"), clock(as_of)) < days)


def where(rows: DataFrame, **asked) -> DataFrame:
    """A value: equal to it; a list: one of it; a pair: between both ends, None for open; None: anything."""
    for column, value in asked.items():
        c = F.col(column)
        if isinstance(value, tuple):
            low, high = (F.lit(x).cast(rows.schema[column].dataType) if x is not None else None for x in value)
            rows = rows if low is None else rows.filter(c >= low)
            rows = rows if high is None else rows.filter(c <= high)
        elif value is not None:
            rows = rows.filter(c.isin(value) if isinstance(value, list) else c == value)
    return rows


def shuffled(rows: DataFrame, seed: int, k: int, id_col: str = "id") -> DataFrame:
    """k rows in a random order that the seed fixes, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(k)


def packed_line(kind: str) -> Column:
    """A row as a line of a prompt: text, xml or json."""
    c, i, t = F.coalesce("category", F.lit("")), F.col("importance").cast("string"), F.coalesce("content", F.lit(""))
    if kind == "text":
        return F.concat(F.lit("["), c, F.lit("] "), t)
    if kind == "xml":
        return F.concat(F.lit('<memory id="'), F.col("id").cast("string"), F.lit('" category="'), c, F.lit('" importance="'), i, F.lit('">\n'), t, F.lit("\n</memory>"))
    return F.to_json(F.struct("id", c.alias("category"), "importance"))


#: A sentence for each kind of event.
SENTENCES = {"purchase": "User %d bought something for %.2f", "error": "User %d met an error", "signup": "User %d signed up", "click": "User %d clicked", "view": "User %d viewed a page"}


def narrated(kind: Column, user: Column, value: Column) -> Column:
    """The sentence for an event; null for a kind without one."""
    out = F.lit(None).cast("string")
    for name, form in SENTENCES.items():
        out = F.when(kind == name, F.format_string(form, user, value)).otherwise(out)
    return out


def document_links(rows: DataFrame) -> DataFrame:
    """(source_id, target_id, type): a link from each row to the one of twice its id."""
    kinds = F.array(*[F.lit(x) for x in ("similarity", "contradicts", "updates")])
    return rows.select(F.col("id").alias("source_id"), (F.col("id") * 2 + 1).alias("target_id"), F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")).alias("type"))


def both_ends(links: DataFrame, ends: DataFrame, id_col: str = "id") -> DataFrame:
    """Links whose source and target both stand in ``ends``."""
    kept = ends.select(F.col(id_col).alias("_end")).distinct()
    for side in ("source_id", "target_id"):
        links = links.join(kept, links[side] == kept["_end"], "left_semi")
    return links


def touching(links: DataFrame, ids: list[int]) -> DataFrame:
    """(id): the ends of all links at one of the ids; two scans of equal keys instead of one either-or join."""
    ends = links.filter(F.col("source_id").isin(ids)).unionByName(links.filter(F.col("target_id").isin(ids)))
    return ends.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def across(links: DataFrame, names: DataFrame, at: int) -> DataFrame:
    """(id, name, n): what stands at the other end of an entity's links, and how many join them."""
    own = links.filter((F.col("source_id") == at) | (F.col("target_id") == at))
    return own.select(F.when(F.col("source_id") == at, F.col("target_id")).otherwise(F.col("source_id")).alias("id")).join(names, "id").groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def with_parent(rows: DataFrame, parents: DataFrame, key: str, name: str, missing: str) -> DataFrame:
    return rows.join(parents, key, "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(bridge, left_key).join(right, right_key)


def shared(bridge: DataFrame, over: str, of: str) -> DataFrame:
    """(a, b, shared): how many ``over`` two ``of`` have in common, a < b; for bridges with few ``of`` to each ``over``."""
    pair = bridge.select(over, F.col(of).alias("a")).join(bridge.select(over, F.col(of).alias("b")), over).filter("a < b")
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def counted(rows: DataFrame, others: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """``rows`` with counts of what refers to them, 0 for none; counted before the join."""
    n = others.groupBy(key).agg(*[c.alias(name) for name, c in counts.items()])
    return rows.join(n, key, "left").fillna(0, list(counts))


def stats(rows: DataFrame) -> DataFrame:
    forgotten, static = F.col("is_forgotten"), F.col("is_static")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(forgotten).alias("forgotten"), F.count_if(static & ~forgotten).alias("static"), F.count_if(~static & ~forgotten).alias("dynamic"), F.count_if(F.col("version") > 1).alias("versioned"),
        F.count_if(F.col("is_archived") & ~forgotten).alias("archived"), F.count_distinct("category").alias("categories"), F.count_if(F.col("access_count") == 0).alias("never_accessed"),
    )


def community_stats(rows: DataFrame, most: int = 50) -> DataFrame:
    categories = F.array_join(F.array_sort(F.collect_set("category")), ",")
    return rows.groupBy("community").agg(F.count(F.lit(1)).alias("n"), scores.half_up(F.avg("importance"), 1).alias("mean_importance"), categories.alias("categories")).orderBy(F.desc("n"), "community").limit(most)


def recency_tiers(rows: DataFrame, as_of: str) -> DataFrame:
    """(tier, n): seven tiers by when a row was last read, or written if it never was."""
    last, old = F.col("last_accessed_at"), lambda c, days: scores.days_between(F.col(c), clock(as_of)) > days
    never = last.isNull()
    tier = F.when(never & old("created_at", 90), "never_accessed_90d+").when(never & old("created_at", 30), "never_accessed_30d+").when(never, "never_accessed_recent")
    tier = tier.when(old("last_accessed_at", 365), "cold_365d+").when(old("last_accessed_at", 90), "cold_90d+").when(old("last_accessed_at", 30), "cool_30d+").otherwise("hot")
    return rows.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def skills(events: DataFrame) -> DataFrame:
    """Users of the event log as skills: purchases complete, clicks and purchases apply."""
    t = F.col("event_type")
    own = events.groupBy(F.col("user_id").alias("skill")).agg(F.count(F.lit(1)).alias("selections"), F.count_if(t == "purchase").alias("completions"), F.count_if(t.isin("click", "purchase")).alias("applied"), F.max("ts").alias("last_updated"))
    return own.withColumn("is_active", F.col("skill") % 4 != 0)


def skill_stats(own: DataFrame) -> DataFrame:
    rate = F.try_divide("completions", "selections")
    return own.groupBy("is_active").agg(F.count(F.lit(1)).alias("n"), F.sum("selections").alias("selections"), F.sum("completions").alias("completions"), F.round(F.avg(rate), 6).alias("mean_rate"))


def skill_scores(own: DataFrame, as_of: str) -> DataFrame:
    """Half completion, 0.3 application, 0.2 recency over 90 days; 0 without selections."""
    recency = F.greatest(F.lit(0.0), 1 - scores.days_between(F.col("last_updated"), clock(as_of)) / 90)
    score = 0.5 * F.col("completions") / F.col("selections") + 0.3 * F.col("applied") / F.col("selections") + 0.2 * recency
    return own.select("skill", F.round(F.when(F.col("selections") > 0, score).otherwise(0.0), 6).alias("score"))


def rubric_score(rubric: list[tuple[str, float, float, float]]) -> Column:
    """Weighted mean of the criteria (name, weight, least, most), each scaled to 0..1; one whose ends meet counts 0."""
    total = sum(w for _, w, _, _ in rubric)
    parts = [w * (F.col(name) - low) / (high - low) for name, w, low, high in rubric if high > low]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0)) / total if total > 0 else F.lit(0.0)


def score_profiles(rows: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    long = rows.unpivot([key], criteria, "criterion", "score")
    return long.groupBy(key, "criterion").agg(F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.count(F.lit(1)).alias("n"))


def tool_quality(events: DataFrame) -> DataFrame:
    """Calls, successes and failures of each user, mean value (summed as decimals, so in any order), and share of successes."""
    ok = F.count_if(F.col("event_type") != "error")
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("calls"), ok.alias("successes"), F.count_if(F.col("event_type") == "error").alias("failures"),
        F.round(F.avg(F.col("value").cast("decimal(18,4)")).cast("double"), 3).alias("mean_ms"), F.round(ok / F.count(F.lit(1)), 6).alias("quality"),
    )


def error_report(events: DataFrame, as_of: str, hours: int, examples: int = 3) -> DataFrame:
    """Errors of a look-back by user: count, first and last seen, the latest one's severity and the latest examples."""
    since = scores.days_between(F.col("ts"), clock(as_of)) * 24
    errors = events.filter((F.col("event_type") == "error") & (since >= 0) & (since < hours)).withColumn("severity", F.when(F.col("value") >= 150, "critical").otherwise("error"))
    stats_ = errors.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("severity", F.struct("ts", "event_id")).alias("severity"))
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    some = errors.withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= examples)
    shown = some.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"]), ",").alias("examples"))
    return stats_.join(shown, "user_id")


def growth_stats(rows: DataFrame, as_of: str) -> DataFrame:
    new = age(as_of)
    return rows.filter(~F.col("is_forgotten")).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("access_count") == 0).alias("never_accessed"), F.count_if((new >= 0) & (new < 1 / 24)).alias("last_hour"), F.round(F.avg("importance"), 6).alias("mean_importance"))


def top_categories(rows: DataFrame, as_of: str, hours: int, k: int) -> DataFrame:
    new = age(as_of) * 24
    own = rows.filter(~F.col("is_forgotten") & (new >= 0) & (new < hours))
    return own.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(k)


def digest_stats(rows: DataFrame, since: str) -> DataFrame:
    new, changed = F.col("created_at") > clock(since), F.col("updated_at") > clock(since)
    return rows.groupBy("user_id").agg(F.count_if(~F.col("is_forgotten")).alias("total"), F.count_if(new).alias("new"), F.count_if(F.col("is_archived") & changed).alias("archived"), F.count_if(changed & ~new).alias("updated"))


def garbage(rows: DataFrame, links: DataFrame, log: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """(kind, n): the six classes that a clean-up would remove."""
    old = lambda c, days: scores.days_between(F.col(c), clock(as_of)) > days
    n = lambda kind, frame: frame.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    t = F.col("event_type")
    whole = both_ends(links, rows.filter(~F.col("is_forgotten")))
    orphans = links.join(whole.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
    lost = signals.join(rows.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_anti")
    kinds = [
        n("forgotten_stale", rows.filter(F.col("is_forgotten") & old("created_at", 30))), n("orphaned_links", orphans), n("expired_scratch", log.filter((t == "view") & old("ts", 30 / 1440))),
        n("old_audit", log.filter((t == "click") & old("ts", 40))), n("old_jobs", log.filter(t.isin("purchase", "error") & old("ts", 30))), n("orphaned_signals", lost),
    ]
    return reduce(DataFrame.unionAll, kinds)


def appended(old: DataFrame, new: DataFrame, chain: str) -> DataFrame:
    """(id, chain, position): new rows of a chain after its greatest position, by id."""
    last = old.groupBy(chain).agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy(chain).orderBy("id"))
    return new.join(last, chain, "left").select("id", chain, (F.coalesce("last", F.lit(0)) + place).cast("long").alias("position"))


def over_most(rows: DataFrame, key: str, column: str) -> DataFrame:
    """A column divided by its key's greatest value; the greatest are joined, so no key is gathered."""
    most = rows.groupBy(key).agg(F.max(column).alias("_most"))
    return rows.join(most, key).withColumn(column, F.when(F.col("_most") > 0, F.col(column) / F.col("_most")).otherwise(F.col(column))).drop("_most")


def dense_labels(rows: DataFrame) -> DataFrame:
    """(id, community): labels numbered from 0 by the least id that bears each; ranked over one row a label."""
    first = rows.groupBy("label").agg(F.min("id").alias("first"))
    number = first.withColumn("community", (F.row_number().over(Window.orderBy("first")) - 1).cast("long"))
    return rows.join(number, "label").select("id", "community")


def sorted_by(rows: DataFrame, key: str, k: int, allowed: tuple[str, ...] = ("selections", "completions", "applied", "last_updated"), id_col: str = "skill") -> DataFrame:
    """The k first by a key that a caller names; any but the allowed ones sorts by the first of these."""
    return rows.orderBy(F.desc(key if key in allowed else allowed[0]), id_col).limit(k)


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or kept."""
    a, b = before.withColumn("_a", F.lit(True)), after.withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept").alias("change"))


def descendants(parents: DataFrame, start: int, depth: int = 20) -> DataFrame:
    """(id, depth): all below a row in (id, parent_id), its own depth 0, as far as ``depth``."""
    return parents.sparkSession.sql(
        """WITH RECURSIVE line(id, depth) AS (
            SELECT id, 0 FROM {parents} WHERE id = {start}
            UNION ALL
            SELECT p.id, line.depth + 1 FROM line JOIN {parents} p ON p.parent_id = line.id WHERE line.depth < {depth}
        ) SELECT id, depth FROM line""",
        parents=parents, start=start, depth=depth,
    )


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that aren't there yet, each key once."""
    return rows.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def window_counters(rows: DataFrame, key: str, time: str, seconds: int, limit: int) -> DataFrame:
    """(key, n, limited): requests numbered in windows of fixed length that begin with the first request after the last window's end.

    Where a window begins depends on all before it, so a key is read in order; Spark sorts and spills, and two numbers of state are held.
    """
    schema = rows.select(F.col(key).cast("long").alias(key)).schema.add("n", "long").add("limited", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, began, n = None, 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != own or t - began >= seconds * 1_000_000:
                    own, began, n = k, t, 0
                n += 1
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), pa.array([x > limit for x in out], pa.bool_())], schema.fieldNames())

    timed = rows.select(F.col(key).cast("long").alias(key), F.unix_micros(F.col(time).cast("timestamp")).alias("t")).dropna()
    return timed.repartition(key).sortWithinPartitions(key, "t").mapInArrow(run, schema)


def ready(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """Steps (run, step, done) that aren't done while all they need is; what a run lacks isn't waited for."""
    open_ = needs.join(steps.filter(~F.col("done")).select("run", F.col("step").alias("needs")), ["run", "needs"]).select("run", "step")
    return steps.filter(~F.col("done")).join(open_.distinct(), ["run", "step"], "left_anti")


def last_writer(ours: DataFrame, theirs: DataFrame, key: str, time: str) -> DataFrame:
    """Both copies merged: of each key theirs if it is later or ours lacks it."""
    b = theirs.select(*[F.col(c).alias(f"_{c}") for c in theirs.columns])
    win = F.col(key).isNull() | (F.col(f"_{time}") > F.col(time))
    return ours.join(b, F.col(key) == F.col(f"_{key}"), "full").select(*[F.when(win, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ours.columns])


def artifacts(rows: DataFrame, column: str, inline: int) -> DataFrame:
    """(sha256, n, n_bytes, place): each content once; long ones go by hash."""
    size = F.octet_length(column).cast("long")
    own = rows.select(F.sha2(column, 256).alias("sha256"), size.alias("n_bytes")).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("n_bytes"))
    return own.withColumn("place", F.when(F.col("n_bytes") <= inline, "inline").otherwise(F.concat(F.left("sha256", F.lit(2)), F.lit("/"), F.col("sha256"))))
