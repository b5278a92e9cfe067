"""Problem 2: rebuilding conversations from message rows.

Export fragments are runs of a session's messages that overlap those of other fragments; a message is known by its hash. `assemble` takes fragments in any
order: it matches suffixes with prefixes of message hashes, keeps links where a fragment has one successor and that has one predecessor, follows the
paths by pointer doubling, and gives each fragment its place. Sessions that don't come out as one path have gaps and are dropped.

A table of message rows holds no such fragments: its deliveries interleave and hardly overlap (see the README). `conversations` therefore writes the rows as
fragments first: range-partitioned by (session, instant), cut into at most FRAGMENT_ROWS messages, each fragment beginning with the last OVERLAP messages of the
one before, so that a session of any length spreads over tasks. A message's hash is of its id, role, content and timestamp and, where a session has
the same message several times at one instant, which of them it is. All sessions go through `assemble`.

A conversation is kept if every row has a known role and an instant, the first row that isn't system is user, some user row isn't
blank, and each user row is followed, before the next one or the end, by an assistant row that isn't blank.

Defined results: rows without session (null or empty) belong nowhere; null roles and unreadable timestamps break their session; blank is null or
white space only; ties of instants are ordered by seq; exact repeats of rows without id stay as turns of their own; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import blank, cut
from ..operators.deliveries import losing_deliveries
from ..operators.timestamps import normalise_timestamps

ROLES = ("system", "user", "assistant", "tool")
FRAGMENT_ROWS = 2_000
OVERLAP = 16
_FRAGMENT = "session_id string, frag bigint, seqs array<bigint>, hashes array<bigint>, kinds array<tinyint>"


def assemble(fragments: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(session_id, frag, skip, at) of fragments (session_id, frag, hashes) of sessions that form one path: the first `skip` messages repeat what
    the path already has, the fragment begins at message number `at` of the conversation.

    A fragment that lies wholly inside another of its session is dropped. frag is unique; fragments are of bounded length."""
    every = fragments.select("session_id", "frag", "hashes", F.size("hashes").alias("n"))
    # the graph of a session with one fragment has one node and no links
    several = every.groupBy("session_id").agg(F.count("*").alias("k")).filter("k > 1").select("session_id")
    lonely = every.select("session_id", "frag").join(several, "session_id", "left_anti").select("session_id", "frag", F.lit(0).cast("long").alias("skip"), F.lit(0).cast("long").alias("at"))
    base = cut(every.join(several, "session_id", "left_semi"))
    inner = base.select(F.col("session_id").alias("s"), F.col("frag").alias("a"), F.col("n").alias("an"), F.posexplode("hashes").alias("i", "h"))
    heads = base.select(F.col("session_id").alias("t"), F.col("frag").alias("b"), F.col("hashes")[0].alias("hh"), F.col("n").alias("bn"))
    meets = inner.join(heads, (F.col("s") == F.col("t")) & (F.col("h") == F.col("hh")) & (F.col("a") != F.col("b"))).select("s", "a", "b", "i", "an", "bn")
    ha, hb = base.select(F.col("frag").alias("a"), F.col("hashes").alias("ah")), base.select(F.col("frag").alias("b"), F.col("hashes").alias("bh"))
    size = F.least(F.col("an") - F.col("i"), F.col("bn"))
    match = meets.join(ha, "a").join(hb, "b").filter((size >= min_overlap) & (F.slice("ah", F.col("i") + 1, size) == F.slice("bh", F.lit(1), size)))
    match = cut(match.select("s", "a", "b", "i", "an", "bn"))
    inside = match.filter("i + bn < an or (i + bn = an and (bn < an or a < b))").select(F.col("b").alias("frag")).distinct()
    links = match.filter("i + bn > an and i > 0").groupBy("s", "a", "b").agg(F.min("i").alias("i"), F.min("an").alias("an"))
    gone = inside.select("frag")
    links = links.join(gone, links["a"] == gone["frag"], "left_anti").join(gone, links["b"] == gone["frag"], "left_anti")
    links = cut(links)
    one_out = links.groupBy("a").agg(F.count("*").alias("k")).filter("k = 1").select("a")
    one_in = links.groupBy("b").agg(F.count("*").alias("k")).filter("k = 1").select("b")
    steps = cut(links.join(one_out, "a", "left_semi").join(one_in, "b", "left_semi").select(F.col("b").alias("frag"), F.col("a").alias("to"), F.col("i").cast("long").alias("back"), (F.col("an") - F.col("i")).alias("skip")))
    alive = base.select("session_id", "frag", "n").join(gone, "frag", "left_anti")
    # pointer doubling over fragments that have a predecessor; a ring never reaches a start and stays unresolved
    state = steps.select("frag", "to", "back")
    many, rounds = steps.count(), 0
    while many and rounds <= many.bit_length():
        nxt = state.select(F.col("frag").alias("to"), F.col("to").alias("to2"), F.col("back").alias("back2"))
        moved = cut(state.join(nxt, "to", "left").select("frag", F.coalesce("to2", "to").alias("to"), (F.col("back") + F.coalesce("back2", F.lit(0))).alias("back"), F.col("to2").isNotNull().alias("moved")))
        state, rounds = moved.select("frag", "to", "back"), rounds + 1
        if moved.filter("moved").isEmpty():
            break
    loose = state.join(steps.select(F.col("frag").alias("to")), "to", "left_semi").select("frag")  # rings
    placed = alive.join(state, "frag", "left").join(steps.select("frag", "skip"), "frag", "left")
    placed = placed.select("session_id", "frag", F.coalesce("skip", F.lit(0)).cast("long").alias("skip"), F.coalesce("back", F.lit(0)).alias("at"), F.coalesce("to", "frag").alias("path"))
    broken = placed.join(loose, "frag", "left_semi").select("session_id").distinct()
    whole = placed.groupBy("session_id").agg(F.min("path").alias("p"), F.max("path").alias("q")).filter("p = q").select("session_id").join(broken, "session_id", "left_anti")
    return lonely.unionByName(placed.join(whole, "session_id", "left_semi").select("session_id", "frag", "skip", "at"))


def _fragments(batches: Iterator, most: int) -> Iterator:
    """Sorted rows (session_id, utc_us, seq, h, kind) to fragments; a session may go on in the next batch."""
    import pandas as pd
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    names = [x.split()[0] for x in _FRAGMENT.split(", ")]
    session, instant, seqs, hashes, kinds = None, None, [], [], []
    again: dict[int, int] = {}
    for b in batches:
        done = []
        for s, us, q, h, k in zip(b["session_id"], b["utc_us"].tolist(), b["seq"].tolist(), b["h"].tolist(), b["kind"].tolist()):
            if seqs and (s != session or len(seqs) >= most):
                number += 1
                done.append((session, number, seqs, hashes, kinds))
                seqs, hashes, kinds = [], [], []
            if s != session or us != instant:
                session, instant = s, us
                again.clear()
            n = again[h] = again.get(h, -1) + 1
            seqs.append(q)
            hashes.append(h if n == 0 else (h + n * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63))
            kinds.append(k)
        if done:
            yield pd.DataFrame(done, columns=names)
    if seqs:
        yield pd.DataFrame([(session, number + 1, seqs, hashes, kinds)], columns=names)


def conversations(messages: DataFrame, sessions: DataFrame | None, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(session_id, turn_no, seq) of the kept conversations; turn_no counts from 1."""
    rows = messages.select("seq", "id", "session_id", "role", "content", "timestamp").filter("session_id != ''")
    lost = losing_deliveries(messages.filter("id is not null")).select("seq")
    rows = normalise_timestamps(rows, sessions)
    said = ~blank(F.col("content"))
    kind = F.when(F.col("role") == "user", 1).when((F.col("role") == "assistant") & said, 2).otherwise(0)
    good = F.coalesce(F.col("role").isin(*ROLES) & F.col("utc_us").isNotNull(), F.lit(False))
    rows = rows.select("session_id", "utc_us", "seq", F.xxhash64("id", "role", "content", "timestamp").alias("h"), kind.cast("tinyint").alias("kind"), good.alias("good"), (F.col("role") == "system").alias("sys"), said.alias("said"))
    rows = cut(rows.join(lost, "seq", "left_anti"))
    order = F.struct("utc_us", "seq")
    sound = rows.groupBy("session_id").agg(
        F.min("good").alias("good"),
        F.min_by(F.when(~F.col("sys"), F.col("kind")), F.when(~F.col("sys"), order)).alias("first"),
        F.max(F.coalesce((F.col("kind") == 1) & F.col("said"), F.lit(False))).alias("asked"),
    )
    sound = sound.filter("good and first = 1 and asked").select("session_id")
    kept = rows.join(sound, "session_id", "left_semi").select("session_id", "utc_us", "seq", "h", "kind")
    # rows of one instant stay together, so that repeats among them are counted
    ordered = kept.repartitionByRange("session_id", "utc_us").sortWithinPartitions("session_id", "utc_us", "seq")
    fragments = cut(ordered.mapInPandas(lambda b: _fragments(b, fragment_rows), _FRAGMENT))
    pieces = cut(overlapping(fragments))
    ways = cut(assemble(pieces.select("session_id", "frag", "hashes")))
    rest = lambda c: F.slice(c, (F.col("skip") + 1).cast("int"), F.size(c)).alias(c)
    placed = pieces.drop("hashes").join(ways.select("frag", "skip", "at"), "frag").select("session_id", "frag", (F.col("at") + F.col("skip")).alias("at"), rest("seqs"), rest("kinds"))
    placed = placed.withColumn("spoken", F.filter("kinds", lambda k: k > 0))
    twice = F.exists(F.zip_with("spoken", F.slice("spoken", F.lit(2), F.size("spoken")), lambda a, b: (a == 1) & (b == 1)), lambda x: F.coalesce(x, F.lit(False)))
    placed = placed.select("session_id", "frag", "at", "seqs", F.try_element_at("spoken", F.lit(1)).alias("first_kind"), F.try_element_at("spoken", F.lit(-1)).alias("last_kind"), twice.alias("unanswered"))
    # over the fragments of a path: an open question at the end of one must be answered before anything else is asked
    chain = W.partitionBy("session_id").orderBy("at")
    spoken = placed.filter("first_kind is not null").select("session_id", "last_kind", F.lead("first_kind").over(chain).alias("then"))
    unanswered = spoken.filter("last_kind = 1 and coalesce(then, 1) = 1").select("session_id").union(placed.filter("unanswered").select("session_id")).distinct()
    placed = placed.join(unanswered, "session_id", "left_anti").select("session_id", "seqs", "at")
    turns = placed.select("session_id", "at", F.posexplode("seqs").alias("i", "seq"))
    return turns.select("session_id", (F.col("at") + F.col("i") + 1).alias("turn_no"), "seq")


def overlapping(fragments: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Each fragment led by the last messages of the one before in its session, by number."""
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - overlap + 1), F.lit(overlap)).alias(c)
    tails = fragments.select("session_id", "frag", F.struct(tail("seqs"), tail("hashes"), tail("kinds")).alias("tail"))
    before = tails.select("frag", F.lag("tail").over(W.partitionBy("session_id").orderBy("frag")).alias("before")).filter("before is not null")
    led = lambda c: F.when(F.col("before").isNull(), F.col(c)).otherwise(F.concat(f"before.{c}", c)).alias(c)
    return fragments.join(before, "frag", "left").select("session_id", "frag", led("seqs"), led("hashes"), led("kinds"))


def with_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """The role and content of each turn."""
    return turns.join(messages.select("seq", "role", "content"), "seq").select("session_id", "turn_no", "seq", "role", "content")
