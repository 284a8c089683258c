"""Incremental work: index diffs, debouncing, rate limits, idempotency, change feeds and crawls, in batch form."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import without_fragment
from sparkloom.operators import limits
from sparkloom.operators.dml import first_rows
from sparkloom.operators.numbering import with_checkpoints
from sparkloom.sources.files import removed_quietly

#: Of more nodes than SMALL, pointers are led up to one of LEADERS nodes first.
SMALL, LEADERS = 200_000, 8
MODES = {"upload": ("upload", "update_remote"), "download": ("download", "update_local"), "manual": (), "auto": ("upload", "download", "update_local", "update_remote", "local_conflict", "remote_conflict", "refresh", "forget")}


def index_diff(local: DataFrame, remote: DataFrame, state: DataFrame) -> DataFrame:
    """A row per path of either index with the action to take. local and remote: rel_path, mtime, size, md5; state:
    rel_path of what was in both before.

    A path of one side alone is new there, or was deleted on the other if state knows it. Equal size and content:
    refresh what state holds. Else the newer side wins, the remote one at equal times, and the loser is kept as a
    conflict: remote_conflict if the local side wins, local_conflict if the remote one does."""
    names = ("mtime", "size", "md5")
    left = local.select("rel_path", *[F.col(c).alias(f"local_{c}") for c in names], F.lit(True).alias("is_local"))
    right = remote.select("rel_path", *[F.col(c).alias(f"remote_{c}") for c in names], F.lit(True).alias("is_remote"))
    known = state.select("rel_path", F.lit(True).alias("is_known")).distinct()
    both = left.join(right, "rel_path", "full_outer").join(known, "rel_path", "left")
    same = (F.col("local_size") == F.col("remote_size")) & F.col("local_md5").eqNullSafe(F.col("remote_md5"))
    action = (
        F.when(F.col("is_remote").isNull(), F.when(F.col("is_known"), "delete_local").otherwise("upload"))
        .when(F.col("is_local").isNull(), F.when(F.col("is_known"), "delete_remote").otherwise("download"))
        .when(same, "refresh")
        .when(F.col("local_mtime") > F.col("remote_mtime"), "remote_conflict")
        .otherwise("local_conflict")
    )
    return both.select("rel_path", *[f"local_{c}" for c in names], *[f"remote_{c}" for c in names], action.alias("action"))


def permitted(actions: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return actions.where(F.col("action").isin(*MODES[mode])) if MODES[mode] else actions.where(F.lit(False))


def split_moves(events: DataFrame) -> DataFrame:
    """Watcher events (path, op, src, ts) with each move as a creation of path and a deletion of src."""
    event = lambda path, op: F.struct(path.alias("path"), op.alias("op"))
    own = event(F.col("path"), F.col("op"))
    parts = F.when(F.col("op") == "moved", F.array(event(F.col("path"), F.lit("created")), event(F.col("src"), F.lit("deleted")))).otherwise(F.array(own))
    return events.select(F.inline(parts), "ts")


def debounce(events: DataFrame, key: str = "path", ts: str = "ts", op: str = "op", gap: str = "1 second") -> DataFrame:
    """Per key and burst, in which no pause reaches gap: its first and last time, count and last op."""
    window = F.session_window(ts, gap)
    out = events.groupBy(key, window.alias("w")).agg(F.max_by(op, ts).alias(op), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
    return out.drop("w")


def fixed_window_limit(requests: DataFrame, key: str, ts: str, order: str, seconds: float = 60, limit: int = 10, parts: int | None = None) -> DataFrame:
    """requests with allowed and hits: a window begins with the first hit and ends seconds later; hits beyond limit
    are refused. A key's requests follow one another by time and order; a frequent key's are handled in several parts.
    Requests without a time are neither allowed nor counted (null)."""
    return limits.decided(requests, key, ts, order, limits.FixedWindow(round(seconds * 1e6), limit), parts)


def sliding_log_limit(requests: DataFrame, key: str, ts: str, order: str, seconds: float = 60, limit: int = 10, parts: int | None = None) -> DataFrame:
    """requests with allowed and hits: refused if limit accepted hits lie within the last seconds; refused ones don't
    count. Parts are as those of fixed_window_limit()."""
    return limits.decided(requests, key, ts, order, limits.SlidingLog(round(seconds * 1e6), limit), parts)


def idempotent(requests: DataFrame, key: str, ts: str, order: str, hours: int = 24, parts: int | None = None) -> DataFrame:
    """requests with `fresh`, false for one that repeats another of the key less than hours before. A repeat doesn't
    extend the time: it runs from the request that was fresh."""
    return fixed_window_limit(requests, key, ts, order, hours * 3600, 1, parts).withColumnRenamed("allowed", "fresh").drop("hits")


def answered(events: DataFrame, key: str, ts: str, order: str, response: str, is_completion: Column, hours: int = 24, parts: int | None = None) -> DataFrame:
    """events, requests and completions of the work that a key's first request starts, with an outcome: started;
    refused, while the work goes on; answered, with the response of the completion as `answer`; completed. A key is
    forgotten hours after it was started, or completed, whichever was last, so that the next request starts anew.
    Requests with a null key guard nothing: all are started. order is a number that no other event of the key has."""
    is_completion = F.coalesce(is_completion, F.lit(False))
    marked = events.withColumn("__end", is_completion.cast("long"))
    found = limits.decided(marked.where(F.col(key).isNotNull()), key, ts, order, limits.Answers(round(hours * 3.6e9), "__end", order), parts).withColumnRenamed("answer", "__answer")
    given = marked.where(is_completion & F.col(key).isNotNull()).select(F.col(key).alias("__of"), F.col(order).alias("__id"), F.col(response).alias("answer"))
    found = found.join(given, (F.col(key) == F.col("__of")) & (F.col("__answer") == F.col("__id")), "left").drop("__of", "__id", "__answer", "__end")
    free = marked.where(F.col(key).isNull()).drop("__end").withColumns({"outcome": F.when(is_completion, "completed").otherwise("started"), "answer": F.lit(None).cast(events.schema[response].dataType)})
    return found.unionByName(free)


def first_in_day(requests: DataFrame, key: Column, ts: str, order: str) -> DataFrame:
    """The first request per key and calendar day, without state."""
    days = requests.withColumns({"__key": key, "__day": F.to_date(ts)})
    return first_rows(days, ["__key", "__day"], F.struct(ts, order)).drop("__key", "__day")


def apply_changes(index: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """index with the last change per key applied: removed ones go, others replace or add."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("c"))
    kept = index.join(last.select(key), key, "left_anti")
    new = last.where(~F.col("c.removed")).select(key, *[F.col(f"c.{c}") for c in index.columns if c != key])
    return kept.unionByName(new.select(*index.columns))


def changes_after(feed: DataFrame, state: DataFrame | None, page: str) -> tuple[DataFrame, DataFrame]:
    """Of a feed's changes, in pages numbered by page, those after the page that state (page) holds, and the state
    to keep once they are applied. Without a state nothing is taken: the first call only notes where the feed stands.
    The feed's end is read first and bounds what is taken, so that a page that comes meanwhile is left for next time."""
    end = feed.agg(F.max(page)).first()[0]
    stand = None if state is None else state.agg(F.max("page")).first()[0]
    after = F.lit(False) if state is None or end is None else (F.col(page) <= end) & (F.lit(True) if stand is None else F.col(page) > stand)
    kept = [x for x in (end, stand) if x is not None]
    return feed.where(after), feed.sparkSession.createDataFrame([(max(kept, default=None),)], T.StructType([T.StructField("page", feed.schema[page].dataType)]))


def by_value(index: DataFrame, key: str, value: str, wanted: DataFrame) -> DataFrame:
    """wanted (value) with the key that index has for it, the least of several; null if it has none."""
    return wanted.join(index.groupBy(value).agg(F.min(key).alias(key)), value, "left")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url and href of each page's links to pages of its own host, both without fragments: what an href means beside
    its page's URL, of those that are absolute or begin with a slash; others are left out."""
    base = without_fragment(F.col(url))
    origin = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    found = pages.select(base.alias("url"), origin.alias("__origin"), F.explode(F.regexp_extract_all(F.col(html), F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))).alias("__href"))
    href = without_fragment(F.when(F.col("__href").rlike(r"^/(?!/)"), F.concat("__origin", "__href")).when(F.col("__href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("__href")))
    return found.select("url", href.alias("href")).where(host(F.col("href")) == host(F.col("url"))).distinct()


def crawl(edges: DataFrame, start: DataFrame, depth: int, internal: bool = True) -> DataFrame:
    """url and depth of all pages within depth links (url, href) of start (url), breadth first, by URLs without their
    fragments; links to another host aren't followed if internal. The frontier and what was seen are written each
    level, so that a lost executor repeats one level."""
    edges = edges.select(without_fragment(F.col("url")).alias("url"), without_fragment(F.col("href")).alias("href"))
    if internal:
        edges = edges.where(host(F.col("url")).eqNullSafe(host(F.col("href"))))
    seen = start.select(without_fragment(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        step = edges.join(frontier.select("url"), "url").select(F.col("href").alias("url")).where("url is not null").distinct()
        frontier = step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)).checkpoint()
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def _above(nodes: DataFrame, step: Column, first: Column, name: str, small: int = SMALL) -> tuple[DataFrame, int]:
    """id, top and name of nodes (id, parent and what first needs) that lead up to one without a parent. name is first
    at the start and step of what both hold, `upper` and `lower`, where a pointer goes on. Also the number of turns.
    Nodes in circles, below them or below an unknown id are left out."""
    with_checkpoints(nodes.sparkSession)
    place = f"{nodes.sparkSession.sparkContext.getCheckpointDir()}/above-{uuid.uuid4().hex[:12]}"
    atexit.register(removed_quietly, nodes.sparkSession, place)
    is_root = F.col("parent").isNull()
    return _lifted(nodes.select("id", F.when(is_root, F.col("id")).otherwise(F.col("parent")).alias("top"), first.alias(name), is_root.alias("done")), step, name, place, small)


def _lifted(state: DataFrame, step: Column, name: str, place: str, small: int, level: int = 0) -> tuple[DataFrame, int]:
    """What _above() returns, of id, top, name and done, by pointer doubling: each turn a node's pointer goes on to
    where the one it points to points, so that turns grow with the logarithm of the depth. Of more than small nodes,
    pointers wait at leaders, one of LEADERS nodes by a hash, which few turns reach; the leaders alone, with pointers
    to leaders, are then led up likewise, and the others take what their leader has. Only pointers that went on are
    written by a turn, so that a lost executor repeats it alone and tasks don't add up over turns."""
    spark, kind = state.sparkSession, state.schema["top"].dataType
    folder = f"{place}/{level}"
    state.withColumn("turn", F.lit(0)).write.parquet(f"{folder}/0")
    now = spark.read.parquet(f"{folder}/0")
    columns, n = now.schema, now.count()
    leads = lambda c: (F.xxhash64(F.col(c).cast(kind), F.lit(level)) % LEADERS == 0) if n > small else F.lit(False)
    goes_on = ~F.col("done") & ~leads("top")
    most, turns = n.bit_length() + 1, 0
    while turns < most and now.where(goes_on).limit(1).count():
        turns += 1
        upper = now.where(~leads("id")).select(F.col("id").alias("top"), F.col("top").alias("__top"), F.col(name).alias("upper"), F.col("done").alias("__done"))
        lower = now.where(goes_on).select("id", "top", F.col(name).alias("lower"))
        went = lower.join(upper.hint("merge"), "top").select("id", F.col("__top").alias("top"), step.alias(name), F.col("__done").alias("done"), F.lit(turns).alias("turn"))
        went.write.parquet(f"{folder}/{turns}")
        now = spark.read.schema(columns).parquet(*[f"{folder}/{i}" for i in range(turns + 1)]).where(~goes_on | (F.col("turn") == turns))
    found = now.where("done").select("id", "top", name)
    if n <= small:
        return found, turns
    led, more = _lifted(now.where(leads("id") & ~goes_on).drop("turn"), step, name, place, small, level + 1)
    upper = led.select(F.col("id").alias("top"), F.col("top").alias("__top"), F.col(name).alias("upper"))
    lower = now.where(~F.col("done") & leads("top")).select("id", "top", F.col(name).alias("lower"))
    return found.unionByName(lower.join(upper.hint("merge"), "top").select("id", F.col("__top").alias("top"), step.alias(name))), turns + more


def depths(nodes: DataFrame) -> DataFrame:
    """id, root and depth of every node (id, parent) that leads up to one without a parent, whose depth is 0; ids must
    not repeat."""
    found, _ = _above(nodes, F.col("upper") + F.col("lower"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long"), "depth")
    return found.select("id", F.col("top").alias("root"), "depth")


def paths(nodes: DataFrame) -> DataFrame:
    """id and path of every node (id, name, parent): the names from the root, joined by slashes; nodes whose parents
    form a circle or lead nowhere are left out. Rows that repeat count once; an id with several names or parents is an
    error. Depths are found first, so that no path is made of a circle."""
    nodes = nodes.select("id", "name", "parent").distinct()
    if nodes.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id has several names or parents")
    sound = nodes.join(depths(nodes).select("id"), "id", "left_semi")
    found, _ = _above(sound, F.concat_ws("/", "upper", "lower"), F.coalesce("name", F.lit("")), "path")
    return found.select("id", "path")
