"""Sessions of clicks: a state machine over clicks that are shuffled by client and sorted inside partitions.

Two of the three ends of a session depend on neighbouring clicks only: after a final click, and after a pause.  They cut a client's
clicks into *stretches* without regard to where sessions began, so a client with a third of all clicks is not one group: the
shuffle is by client and stretch.  To find the cuts, clicks are dealt by client and hour; what an hour needs of earlier hours
(their last click, their last cut) comes from one row per client and hour, so a window over a client's rows is bounded by hours,
however many clicks the client has.

The third end, a session's age, does depend on where it began.  The machine carries it through the sorted clicks of a stretch,
across the batches in which Python gets them: the session's first click, its last click, its counters and the digest of its path
so far.  It holds one batch and one open session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
SESSION_TYPE = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"
SESSION_COLUMNS = [c.split()[0] for c in SESSION_TYPE.split(", ")]


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time stamp; one without a zone is taken as UTC whatever the session's zone is."""
    c = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * MINUTE + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


class Session:
    """An open session: its key, first click, last click, counters, and the digest of its path so far."""

    __slots__ = ("key", "first", "start", "end", "final", "n", "late", "cents", "path")

    def __init__(self, key: tuple[int, int], first: int, start: int):
        self.key, self.first, self.start = key, first, start
        self.end, self.final, self.n, self.late, self.cents, self.path = start, False, 0, 0, 0, hashlib.sha256()

    def add(self, texts: list[str], end: int, final: bool, late: int, cents: int) -> None:
        """Timely clicks in order, the last one's time and finality, and how many late clicks lie among or behind them."""
        if texts:
            if self.n:
                self.path.update(b",")
            self.path.update(",".join(texts).encode())
            self.n += len(texts)
            self.end, self.final = end, final
        self.late += late
        self.cents += cents

    def row(self, closed_by: str) -> tuple:
        return self.key[0], self.first, self.start, self.end, self.n, self.late, self.cents, closed_by, self.path.hexdigest()


def machine(batches: Iterator[pd.DataFrame], oldest: int) -> Iterator[pd.DataFrame]:
    """Sessions of clicks that arrive sorted by client, stretch, time, late, click; the open session goes on to the next batch."""
    session: Session | None = None
    client_ends = 0

    def ended() -> tuple:
        return session.row("end" if session.final else "none" if session.end == client_ends else "gap")

    for pdf in batches:
        if not len(pdf):
            continue
        out: list[tuple] = []
        client, stretch, us, click = (pdf[c].to_numpy() for c in ("client", "stretch", "us", "click"))
        late, final, last_us = pdf["late"].to_numpy(), pdf["final"].to_numpy(), pdf["client_ends"].to_numpy()
        cents = np.append(0, np.cumsum(np.where(late, 0, pdf["cents"].to_numpy())))
        timely = np.flatnonzero(~late)
        texts = pa.array(click[timely]).cast(pa.string()).to_pylist()
        timely_us = us[timely]
        heads = np.flatnonzero(np.append(True, (client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1])))
        inside = np.searchsorted(timely, np.append(heads, len(us))).tolist()
        for k, (lo, hi) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(us)])):
            a, b = inside[k], inside[k + 1]
            key = (int(client[lo]), int(stretch[lo]))
            if session is not None and session.key != key:
                out.append(ended())
                session = None
            if session is None:  # a stretch begins with a timely click
                session = Session(key, int(click[lo]), int(us[lo]))
            client_ends = int(last_us[lo])
            while True:
                bound = session.start + oldest
                c = b if a == b or timely_us[b - 1] <= bound else a + int(np.searchsorted(timely_us[a:b], bound, "right"))
                to = hi if c == b else int(timely[c])
                if c > a:
                    session.add(texts[a:c], int(timely_us[c - 1]), bool(final[timely[c - 1]]), to - lo - (c - a), int(cents[to] - cents[lo]))
                else:
                    session.add([], 0, False, to - lo, 0)
                if c == b:
                    break
                out.append(session.row("length"))
                session, a, lo = Session(key, int(click[to]), int(us[to])), c, to
        if out:
            yield pd.DataFrame(out, columns=SESSION_COLUMNS)
    if session is not None:
        yield pd.DataFrame([ended()], columns=SESSION_COLUMNS)


def stretches(clicks: DataFrame, pause: int, hour: int) -> DataFrame:
    """Clicks with the first click of their stretch, and the time of their client's last timely click; late clicks before any go."""
    ordered = Window.partitionBy("client", "cell").orderBy("us", "late", "click")
    before, so_far = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timely = ~F.col("late")
    rows = clicks.withColumn("cell", F.floor(F.col("us") / hour).cast("long")).withColumns(
        {
            "prev_us": F.max(F.when(timely, F.col("us"))).over(before),
            "prev_final": F.last(F.when(timely, F.col("final")), ignorenulls=True).over(before),
            "behind": F.lead("click").over(ordered),
        }
    )
    cut = timely & (F.col("prev_final") | (F.col("us") - F.col("prev_us") >= pause))
    opens = timely & F.col("prev_us").isNull()
    rows = rows.withColumns({"cut": F.last(F.when(cut, F.col("click")), ignorenulls=True).over(so_far), "opener": F.max(F.when(opens, F.col("click"))).over(so_far), "first_us": F.max(F.when(opens, F.col("us"))).over(so_far)})
    # an hour's last row knows the whole hour
    last_us, last_final = (F.when(timely, F.col(c)).otherwise(F.col(f"prev_{c}")).alias(f"last_{c}") for c in ("us", "final"))
    hours = rows.filter(F.col("behind").isNull()).select("client", "cell", "cut", "opener", "first_us", last_us, last_final)
    by_hour = Window.partitionBy("client").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumns({"p_us": F.max("last_us").over(by_hour), "p_final": F.last("last_final", ignorenulls=True).over(by_hour)})
    opener_cuts = F.col("p_us").isNull() | F.col("p_final") | (F.col("first_us") - F.col("p_us") >= pause)
    hours = hours.withColumn("opening", F.when(opener_cuts, F.col("opener")))
    carried = F.last(F.coalesce("cut", "opening"), ignorenulls=True).over(by_hour)
    hours = hours.select("client", "cell", "opening", carried.alias("carried"), F.max("last_us").over(Window.partitionBy("client")).alias("client_ends"))
    joined = rows.join(hours.hint("merge"), ["client", "cell"])
    stretch = F.coalesce("cut", F.when(F.col("opener").isNotNull(), F.col("opening")), "carried")
    return joined.select("client", stretch.alias("stretch"), "us", "late", "click", "final", "cents", "client_ends").filter("stretch IS NOT NULL")


def sessions(
    clicks: DataFrame,
    final: Column,
    cents: Column,
    id_col: str = "click_id",
    client_col: str = "client_id",
    ts_col: str = "ts",
    arrived_col: str = "arrived_at",
    pause: int = 15 * MINUTE,
    oldest: int = 60 * MINUTE,
    lateness: int = 15 * MINUTE,
    hour: int = 60 * MINUTE,
) -> DataFrame:
    """A row per session: client_id, session_id (its first click), start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256.

    Times are microseconds.  A click that arrived more than ``lateness`` after its time is late and joins no session; it counts for the
    session at whose time it was.  A client's timely clicks, by time, then id, continue a session unless the one before is ``final``
    (``end``) or at least ``pause`` earlier (``gap``), or the session's first is more than ``oldest`` earlier (``length``); a session's
    ``closed_by`` is the first of these that its next timely click meets, without one ``end`` or ``none``.

    Rows without id, client or time take no part.  Of rows with one id the least counts (by time, then the rest), so repeated rows count
    once.  A missing arrival is timely; a null ``final`` is false, null ``cents`` are 0.  Equal times are told apart by id; a late click
    at the time of a session's start counts for it.  An empty table gives an empty result.  Other columns are ignored, whatever their
    names.  ``hour`` is the width of the cells that find the cuts; it changes no result.
    """
    us, arrived = micros(clicks, ts_col), micros(clicks, arrived_col)
    given = clicks.select(
        F.col(id_col).cast("long").alias("click"),
        F.struct(
            us.alias("us"),
            F.col(client_col).cast("long").alias("client"),
            F.coalesce(arrived - us > lateness, F.lit(False)).alias("late"),
            F.coalesce(final, F.lit(False)).alias("final"),
            F.coalesce(cents.cast("long"), F.lit(0)).alias("cents"),
        ).alias("r"),
    ).filter("click IS NOT NULL AND r.us IS NOT NULL AND r.client IS NOT NULL")
    once = given.groupBy("click").agg(F.min("r").alias("r")).select("click", "r.*")
    dealt = stretches(once, pause, hour).repartition("client", "stretch").sortWithinPartitions("client", "stretch", "us", "late", "click")
    return dealt.mapInPandas(lambda batches: machine(batches, oldest), SESSION_TYPE)


def op12_gap_sessions(spark, sf_dir: str) -> DataFrame:
    """Contract query: all clicks; purchases and signups of at least 60 are final."""
    value = F.when(~F.isnan("value"), F.col("value"))
    final = F.col("kind").isin("purchase", "signup") & (value >= 60)
    return sessions(spark.read.parquet(f"{sf_dir}/clicks.parquet"), final, F.floor(100 * value + 0.5))


OP12_SQL = """
WITH RECURSIVE c AS (
  SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) AS late,
    coalesce(kind IN ('purchase', 'signup') AND value >= 60, false) AS fin, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
t AS (SELECT *, lag(us) OVER w AS pu, lag(fin) OVER w AS pf, lead(us) OVER w AS nu FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
s AS (SELECT *, sum(CASE WHEN pu IS NULL OR pf OR us - pu >= 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY us, click_id) AS seg FROM t),
r AS (
  SELECT client_id, seg, min(us) AS su FROM s GROUP BY ALL
  UNION ALL
  SELECT r.client_id, r.seg, min(s.us) FROM r JOIN s ON s.client_id = r.client_id AND s.seg = r.seg AND s.us > r.su + 3600000000 GROUP BY r.client_id, r.seg),
a AS (SELECT s.*, r.su FROM s ASOF JOIN r ON s.client_id = r.client_id AND s.seg = r.seg AND s.us >= r.su),
g AS (
  SELECT client_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents) AS value_cents, arg_min(click_id, (us, click_id)) AS session_id,
    arg_max(fin, (us, click_id)) AS fin, nullif(arg_max(coalesce(nu, -1), (us, click_id)), -1) AS nu, sha256(string_agg(click_id, ',' ORDER BY us, click_id)) AS path_sha256
  FROM a GROUP BY client_id, seg, su),
n AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY start_us, session_id) AS ns FROM g),
l AS (SELECT n.client_id, n.session_id, count(*) AS n_late FROM n JOIN c ON c.late AND c.client_id = n.client_id AND c.us >= n.start_us AND (n.ns IS NULL OR c.us < n.ns) GROUP BY ALL)
SELECT n.client_id, n.session_id, start_us, end_us, CAST(n_clicks AS BIGINT) AS n_clicks, CAST(coalesce(n_late, 0) AS BIGINT) AS n_late, CAST(value_cents AS BIGINT) AS value_cents,
  CASE WHEN fin THEN 'end' WHEN nu IS NULL THEN 'none' WHEN nu - end_us >= 900000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM n LEFT JOIN l ON l.client_id = n.client_id AND l.session_id = n.session_id
"""
