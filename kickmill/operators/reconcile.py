"""Importing validated rows into stored matches: resolution, de-duplication, enrichment, insert-only odds.

Rows of one file act in order, but only rows of the same pairing and day (or the same external id) can affect each other.
So leagues and team names are resolved as sets, and rows are grouped by (league, home, away, date).  Rows that are alone are
decided by joins; groups of several run the rules in row order, as sorted streams.  External ids that span pairings merge their
groups first, unless they decide their rows at once.  Quotes are merged afterwards, for all matches together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickmill.functions import names as N
from kickmill.functions import parse as P
from kickmill.operators.mapping import MappingProfile
from kickmill.operators.similar import best_of, first_come, similar_pairs
from kickmill.operators.splits import global_row_number
from kickmill.session import shared_folder

OUTCOME_COLUMNS = ("row_index", "outcome", "match_id", "new_match", "league_key", "home_team_id", "away_team_id", "match_date", "kickoff_utc", "ft_home", "ft_away", "ht_home", "ht_away", "dedupe_key", "external_id", "add_source", "warnings", "new_odds")


def resolve_leagues(rows: DataFrame, profile: MappingProfile, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``league_key``, new leagues (canonical_key, name, country) in order of first sight)."""
    fixed = profile.fixed_league
    key = F.coalesce(F.trim("league_raw"), F.lit(fixed[0] if fixed else None).cast("string"))
    out = rows.withColumn("league_key", key)
    seen = out.filter(F.col("league_key").isNotNull() & F.col("error").isNull()).groupBy("league_key").agg(F.min("row_index").alias("first_row"))
    codes = rows.sparkSession.createDataFrame([(k, *v) for k, v in profile.league_code_map.items()] or [("", "", "")], "league_key string, _name string, _country string")
    new = seen.join(stored.select(F.col("canonical_key").alias("league_key")), "league_key", "left_anti").join(F.broadcast(codes), "league_key", "left")
    name, country = F.coalesce("_name", F.lit(fixed[1] if fixed else None).cast("string") if fixed else F.col("league_key")), F.coalesce("_country", F.lit(fixed[2] if fixed else None).cast("string"))
    return out, new.select(F.col("league_key").alias("canonical_key"), name.alias("name"), country.alias("country"), "first_row")


def resolve_names(seen: DataFrame, teams: DataFrame, aliases: DataFrame, cutoff: float = 0.92) -> DataFrame:
    """Every distinct name's resolution: exact, alias, fuzzy or created; the pool of names grows in order of first sight.

    seen: (row_index, side, raw, normal), any number of rows.  A name is compared with the stored teams and with the teams that
    earlier names created; a name that resembles one is that team (the most similar, of equals the last in the alphabet).
    """
    shared_folder(seen.sparkSession)
    first = seen.filter("normal IS NOT NULL").groupBy("normal").agg(F.min(F.struct("row_index", "side", "raw")).alias("f"))
    first = first.select(F.col("normal").alias("name"), (F.col("f.row_index") * 2 + F.col("f.side")).alias("place"), "f.raw")
    known = teams.groupBy(F.col("normalized_key").alias("name")).agg(F.max("id").alias("team_id"))
    remembered = aliases.groupBy(F.col("normalized_alias").alias("name")).agg(F.max(F.struct("team_id", "confidence")).alias("_a"))
    known_one = first.join(known.withColumnRenamed("team_id", "_exact"), "name", "left").join(remembered, "name", "left").checkpoint()
    open_ones = known_one.filter("_exact IS NULL AND _a IS NULL").select("name", "place", "raw")
    pool = known.select("name", F.lit(-1).cast("long").alias("place")).unionByName(open_ones.select("name", "place"))
    pairs = similar_pairs(open_ones.select("name", "place"), pool, cutoff).checkpoint()
    created = first_come(open_ones.select("name", "place"), pairs.select("name", "candidate"))
    last = teams.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    numbered = global_row_number(created, ["place"]).select("name", (F.col("_n") + last).alias("team_id")).checkpoint()
    # names can be both stored and created in no case
    ids = known.unionByName(numbered).withColumnRenamed("name", "candidate")
    alike = best_of(pairs.join(ids, "candidate"))
    columns = lambda kind, key, confidence: ("name", F.col("team_id").cast("long").alias("team_id"), F.lit(kind).alias("kind"), "raw", key.alias("matched_key"), confidence.cast("double").alias("confidence"), "first_row")
    name, one = F.col("name"), F.lit(1.0)
    known_one, open_ones = (df.withColumn("first_row", F.floor(F.col("place") / 2).cast("long")) for df in (known_one, open_ones))
    out = known_one.filter("_exact IS NOT NULL").withColumnRenamed("_exact", "team_id").select(*columns("exact", name, one))
    by_alias = known_one.filter("_exact IS NULL AND _a IS NOT NULL").withColumn("team_id", F.col("_a.team_id"))
    out = out.unionByName(by_alias.select(*columns("alias", name, F.col("_a.confidence"))))
    out = out.unionByName(open_ones.join(numbered, "name").select(*columns("created", name, one)))
    out = out.unionByName(open_ones.join(numbered, "name", "left_anti").join(alike, "name").select(*columns("fuzzy", F.col("candidate"), F.col("recorded"))))
    return out.withColumnRenamed("name", "normal")


def resolve_teams(rows: DataFrame, teams: DataFrame, aliases: DataFrame, cutoff: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """(rows with ``home_team_id`` and ``away_team_id``, the resolutions).  Rows without a league name no teams."""
    named = rows.withColumns({"_h": N.normalized(F.col("home_raw")), "_a": N.normalized(F.col("away_raw"))})
    part = named.filter(F.col("error").isNull() & F.col("league_key").isNotNull())
    both = part.select("row_index", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("home_raw").alias("raw"), F.col("_h").alias("normal")), F.struct(F.lit(1).alias("side"), F.col("away_raw").alias("raw"), F.col("_a").alias("normal")))).alias("n"))
    table = resolve_names(both.select("row_index", "n.side", "n.raw", "n.normal"), teams, aliases, cutoff).checkpoint()
    ids = table.select("normal", "team_id")
    out = named.join(ids.withColumnsRenamed({"normal": "_h", "team_id": "home_team_id"}), "_h", "left").join(ids.withColumnsRenamed({"normal": "_a", "team_id": "away_team_id"}), "_a", "left")
    return out.drop("_h", "_a"), table


DECISION = "row_index long, outcome string, match_id long, new_match boolean, add_source boolean"


class _Group:
    """The matches of one group of pairings, and which external ids its rows have linked."""

    def __init__(self):
        self.of: dict[str, list[list]] = {}  # pairing: [id, timed, dedupe key, score]
        self.by_key: dict[str, list] = {}
        self.linked: dict[str, int] = {}

    def add(self, pairing, match: list) -> None:
        self.of.setdefault(pairing, []).append(match)
        self.by_key.setdefault(match[2], match)

    def row(self, pairing, new_id, timed, key, external, score) -> tuple[str, int | None, bool, bool]:
        """(outcome, match, whether it is new, whether the row links its external id), in row order."""
        if external is not None and external in self.linked:
            return "duplicate", self.linked[external], False, False
        if (exact := self.by_key.get(key)) is not None:
            return ("duplicate", exact[0], False, False) if exact[3] == score else ("conflict", None, False, False)
        siblings = self.of.get(pairing, [])
        if timed and len(siblings) == 1 and not siblings[0][1]:
            one = siblings[0]
            self.by_key.pop(one[2], None)
            one[1], one[2] = True, key
            self.by_key[key] = one
            return "enriched", one[0], False, self.link(external, one[0])
        if not timed and siblings:
            return "duplicate", siblings[0][0] if len(siblings) == 1 else None, False, False
        self.add(pairing, [new_id, timed, key, score])
        return "imported", new_id, True, self.link(external, new_id)

    def link(self, external, match_id) -> bool:
        if external is None:
            return False
        self.linked[external] = match_id
        return True


def ruled(batches):
    """Decisions for rows sorted by group, stored matches first, then by row: only the group at hand is held."""
    names, types = zip(*[c.split() for c in DECISION.split(", ")])
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    at, state = None, _Group()
    for batch in batches:
        out = []
        for group, stored, index, pairing, match_id, timed, key, external, home, away in zip(*[c.to_pylist() for c in batch.columns]):
            if group != at:
                at, state = group, _Group()
            if stored:
                state.add(pairing, [match_id, timed, key, (home, away)])
            else:
                out.append((index, *state.row(pairing, match_id, timed, key, external, (home, away))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*out), types)], list(names))


def star_contraction(links: DataFrame) -> DataFrame:
    """(node, root) with the least node of its component as root, of links (node, other), in a logarithmic number of rounds.

    Each round points neighbours at the least node around them, first those above a node, then those below it; every step is a minimum
    per node and a join, so a node with many neighbours gathers nothing in one task.
    """
    shared_folder(links.sparkSession)
    flip = lambda e: e.select(F.col("node").alias("other"), F.col("other").alias("node")).select("node", "other")
    edges = links.filter("node <> other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct().checkpoint()
    before = None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if size == before:
            return edges.select("node", F.col("other").alias("root"))
        before = size
        both = edges.unionByName(flip(edges))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        above = both.filter("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("root").alias("other")).distinct()
        least = above.groupBy("node").agg(F.min("other").alias("root"))
        below = above.join(least, "node").select(F.col("other").alias("node"), F.col("root").alias("other")).filter("node <> other")
        edges = below.unionByName(least.select("node", F.col("root").alias("other"))).distinct().checkpoint()


def linked_groups(rows: DataFrame) -> DataFrame:
    """``group``: rows of one pairing and day share it, and so do groups that name one external id."""
    out = rows.withColumn("group", F.xxhash64("pairing"))
    named = out.filter(F.col("external_id").isNotNull()).select("external_id", "group").distinct()
    least = named.groupBy("external_id").agg(F.min("group").alias("other"), F.max("group").alias("most")).filter("other < most")
    links = named.join(least, "external_id").select(F.col("group").alias("node"), "other")
    roots = star_contraction(links).withColumnRenamed("node", "group")
    return out.join(roots, "group", "left").withColumn("group", F.coalesce("root", "group")).drop("root")


def captured(rows: DataFrame, stored: DataFrame, held: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(decisions of rows that an external id sends to its match whatever their pairing has, the rows that remain).

    An id that is stored takes all its rows.  So does one whose first row is the first of a pairing without stored matches: that row
    is imported and links it.  Rows taken so link their pairings no more, which cuts the groups of most files down to pairings.
    """
    decided = lambda df: df.select("row_index", F.lit("duplicate").alias("outcome"), "match_id", F.lit(False).alias("new_match"), F.lit(False).alias("add_source"))
    held = held.groupBy("external_id").agg(F.min("match_id").alias("match_id"))
    marked = rows.join(held, "external_id", "left").checkpoint()
    out, rest = decided(marked.filter("match_id IS NOT NULL")), marked.filter("match_id IS NULL").drop("match_id")
    for _ in range(rounds):
        first = rest.groupBy("pairing").agg(F.min("row_index").alias("row_index")).join(stored.select("pairing").distinct(), "pairing", "left_anti")
        by_id = rest.filter("external_id IS NOT NULL").groupBy("external_id").agg(F.min(F.struct("row_index", "new_id")).alias("f"), F.count("*").alias("n"))
        links = by_id.filter("n > 1").select("external_id", F.col("f.row_index").alias("row_index"), F.col("f.new_id").alias("match_id")).join(first.select("row_index"), "row_index", "left_semi")
        marked = rest.join(links.withColumnRenamed("row_index", "first_row"), "external_id", "left").checkpoint()
        taken = F.coalesce(F.col("row_index") > F.col("first_row"), F.lit(False))
        out, rest = out.unionByName(decided(marked.filter(taken))), marked.filter(~taken).drop("first_row", "match_id")
    return out, rest


def decide(good: DataFrame, stored: DataFrame, held: DataFrame) -> DataFrame:
    """DECISION of every accepted row (row_index, pairing, new_id, kickoff_utc, dedupe_key, external_id, ft_home, ft_away).

    A row that is alone in its group is decided by joins with the stored matches of its pairing; groups of several rows go through
    the rules in row order, as sorted streams.
    """
    light = good.select("row_index", "pairing", "new_id", F.col("kickoff_utc").isNotNull().alias("timed"), "dedupe_key", "external_id", "ft_home", "ft_away")
    out, rest = None, light.withColumn("group", F.xxhash64("pairing"))
    if light.filter("external_id IS NOT NULL").limit(1).count():
        out, rest = captured(light, stored, held)
        rest = linked_groups(rest)
    rest = rest.withColumn("n", F.count("*").over(Window.partitionBy("group"))).checkpoint()
    alone, several = rest.filter("n = 1"), rest.filter("n > 1")
    beside = stored.groupBy("pairing").agg(F.count("*").alias("siblings"), F.min("id").alias("one"), F.max("timed").alias("one_timed"))
    same_key = stored.groupBy("pairing", "dedupe_key").agg(F.min(F.struct("id", "ft_home", "ft_away")).alias("exact"))
    alone = alone.join(beside, "pairing", "left").join(same_key, ["pairing", "dedupe_key"], "left")
    agrees = F.col("exact.ft_home").eqNullSafe(F.col("ft_home")) & F.col("exact.ft_away").eqNullSafe(F.col("ft_away"))
    one = F.coalesce(F.col("siblings") == 1, F.lit(False))
    outcome = (
        F.when(F.col("exact").isNotNull(), F.when(agrees, "duplicate").otherwise("conflict"))
        .when(F.col("timed") & one & ~F.col("one_timed"), "enriched")
        .when(~F.col("timed") & F.col("siblings").isNotNull(), "duplicate")
        .otherwise("imported")
    )
    alone = alone.withColumn("outcome", outcome)
    match = F.when(F.col("outcome") == "imported", F.col("new_id")).when(F.col("outcome") == "conflict", None).when(F.col("exact").isNotNull(), F.col("exact.id")).when(one, F.col("one"))
    links = F.col("external_id").isNotNull() & F.col("outcome").isin("imported", "enriched")
    decided = alone.select("row_index", "outcome", match.alias("match_id"), (F.col("outcome") == "imported").alias("new_match"), links.alias("add_source"))
    columns = ("group", "stored", "row_index", "pairing", "match_id", "timed", "dedupe_key", "external_id", "ft_home", "ft_away")
    held_matches = stored.join(several.select("pairing", "group").distinct(), "pairing").withColumns({"stored": F.lit(True), "row_index": F.col("id"), "match_id": F.col("id"), "external_id": F.lit(None).cast("string")})
    stream = several.withColumns({"stored": F.lit(False), "match_id": F.col("new_id")}).select(*columns).unionByName(held_matches.select(*columns))
    stream = stream.repartition("group").sortWithinPartitions("group", F.desc("stored"), "row_index")
    decided = decided.unionByName(stream.mapInArrow(ruled, DECISION))
    return decided.unionByName(out) if out is not None else decided


IDENTITY = ("bookmaker", "market", "selection", "line", "price_point")


def merged_quotes(decided: DataFrame, odds: DataFrame) -> DataFrame:
    """(row_index, new_odds, price_warnings) of rows (with ``odds``) that join a match: only what no earlier row or stored quote has.

    Quotes are the same if book, market, selection, line and price point are, nulls alike.  The first counts: a stored one, else that
    of the first row; a later row with another price gets a warning.  Quotes of one row with the same identity are all new.
    """
    joins = decided.filter("match_id IS NOT NULL AND NOT new_match")
    targets = joins.select("match_id").distinct()
    quotes = decided.filter("match_id IS NOT NULL").join(targets, "match_id", "left_semi").select("match_id", "row_index", "new_match", F.posexplode("odds").alias("pos", "q"))
    quotes = quotes.select("match_id", "row_index", "new_match", F.col("pos").cast("long").alias("pos"), "q.*")
    held = odds.join(targets, "match_id", "left_semi").select("match_id", F.lit(-1).cast("long").alias("row_index"), F.col("id").alias("pos"), *IDENTITY, "decimal_odds")
    every = quotes.select("match_id", "row_index", "pos", *IDENTITY, "decimal_odds").unionByName(held)
    first = every.groupBy("match_id", *IDENTITY).agg(F.min(F.struct("row_index", "pos", "decimal_odds")).alias("first")).alias("f")
    quotes = quotes.filter("NOT new_match").alias("q")
    same = F.col("q.match_id") == F.col("f.match_id")
    for c in IDENTITY:
        same &= F.col(f"q.{c}").eqNullSafe(F.col(f"f.{c}"))
    both = quotes.join(first, same).select("q.*", "first")
    own, old = F.col("decimal_odds"), F.col("first.decimal_odds")
    new = F.col("first.row_index") == F.col("row_index")
    close = F.abs(own - old) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(own), F.abs(old)), F.lit(1e-9))
    text = F.concat(F.lit("price conflict "), F.concat_ws("/", "bookmaker", "market", "selection"), F.lit(": kept "), old.cast("string"), F.lit(", not "), own.cast("string"))
    quote = F.struct("bookmaker", "market", "selection", "decimal_odds", "line", "price_point")
    per_row = both.groupBy("row_index").agg(
        F.sort_array(F.collect_list(F.when(new, F.struct("pos", quote.alias("q"))))).alias("n"), F.sort_array(F.collect_list(F.when(~new & ~close, F.struct("pos", text.alias("w"))))).alias("w")
    )
    return per_row.select("row_index", F.transform("n", lambda x: x.q).alias("new_odds"), F.transform("w", lambda x: x.w).alias("price_warnings"))


def import_rows(validated: DataFrame, profile: MappingProfile, store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Run a file's validated rows against the stored tables (leagues, teams, aliases, matches, sources, odds).

    Returns ``outcomes`` (one row per input row), ``resolutions`` and ``leagues`` (new ones).
    """
    # read several times below, and too much code for one stage with what follows
    shared_folder(validated.sparkSession)
    rows, new_leagues = resolve_leagues(validated.checkpoint(), profile, store["leagues"])
    rows, resolutions = resolve_teams(rows, store["teams"], store["aliases"])
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("league_key").isNull(), "no league").when(F.col("home_team_id") == F.col("away_team_id"), "same team")
    rows = rows.withColumn("reject", bad)
    last = store["matches"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    good = rows.filter("reject IS NULL").withColumn("kickoff_utc", P.kickoff_utc(F.col("match_date"), F.col("kickoff_time"), profile.timezone))
    good = good.withColumn("dedupe_key", P.dedupe_key(F.col("league_key"), F.col("home_team_id"), F.col("away_team_id"), F.col("match_date"), F.col("kickoff_utc")))
    pairing = F.concat_ws("|", "league_key", "home_team_id", "away_team_id", F.col("match_date").cast("string"))
    acted = act(good.withColumn("pairing", pairing), store, profile.source_name, last)
    rejected = rows.filter("reject IS NOT NULL").select("row_index", F.col("reject").alias("outcome"))
    return {"outcomes": acted.unionByName(rejected, allowMissingColumns=True), "resolutions": resolutions, "leagues": new_leagues}


def act(good: DataFrame, store: dict[str, DataFrame], source: str, last: int) -> DataFrame:
    """What becomes of accepted rows (with ``pairing``, ids, keys and odds) beside the stored matches, sources and odds.

    New matches have provisional ids by row, after ``last``; final ones are dense.
    """
    shared_folder(good.sparkSession)
    good = good.withColumn("new_id", F.col("row_index") + 1 + last).checkpoint()
    pairing = F.concat_ws("|", "league_key", "home_team_id", "away_team_id", F.col("match_date").cast("string"))
    stored = store["matches"].withColumn("pairing", pairing).join(good.select("pairing").distinct(), "pairing", "left_semi")
    stored = stored.select("id", "pairing", F.col("kickoff_utc").isNotNull().alias("timed"), "dedupe_key", "ft_home", "ft_away")
    held = store["sources"].filter(F.col("source") == source).select("external_id", "match_id")
    decided = good.join(decide(good, stored, held), "row_index").checkpoint()
    merged = merged_quotes(decided, store["odds"])
    out = decided.join(merged, "row_index", "left")
    none = F.array().cast("array<struct<bookmaker:string,market:string,selection:string,decimal_odds:double,line:double,price_point:string>>")
    enriched = F.when(F.col("outcome") == "enriched", F.array(F.lit("date-only match enriched with its kickoff time"))).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), enriched, F.coalesce("price_warnings", F.array().cast("array<string>")))
    out = out.withColumns({"new_odds": F.when(F.col("new_match"), F.col("odds")).otherwise(F.coalesce("new_odds", none)), "warnings": warnings})
    return out.select(*OUTCOME_COLUMNS)


def new_match_ids(outcomes: DataFrame, last: int) -> DataFrame:
    """(provisional id, dense id): 1-based after ``last``, in row order."""
    new = outcomes.filter("new_match").select("match_id", "row_index")
    return global_row_number(new, ["row_index"]).select(F.col("match_id").alias("provisional"), (F.col("_n") + last).alias("id"))


def import_report(outcomes: DataFrame, *by: Column) -> DataFrame:
    """One row of counters (for each ``by``)."""
    kinds = ("imported", "duplicate", "enriched")
    count = lambda test: F.count(F.when(test, 1))
    rejected = ~F.col("outcome").isin(*kinds)
    stored = F.sum(F.when(F.col("outcome") == "imported", F.size("new_odds")).otherwise(0))
    added = F.sum(F.when(F.col("outcome").isin("duplicate", "enriched"), F.size("new_odds")).otherwise(0))
    return outcomes.groupBy(*by).agg(F.count("*").alias("rows_total"), *[count(F.col("outcome") == k).alias(f"rows_{k}") for k in kinds], count(rejected).alias("rows_rejected"), stored.alias("odds_quotes_stored"), added.alias("odds_quotes_backfilled"), F.sum(F.coalesce(F.size("warnings"), F.lit(0))).alias("n_warnings"))


def top_similar(pairs: DataFrame) -> DataFrame:
    """The best of (name, candidate, similarity), ties to the smaller candidate."""
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), "candidate")
    return pairs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
