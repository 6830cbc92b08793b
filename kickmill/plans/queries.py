"""Registered queries of the match and odds engine, each with its DuckDB counterpart where SQL can state it.

Doubles are rounded to six places on both sides, and -0.0 becomes 0.0.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kickmill.functions import goals as G
from kickmill.functions import labels as L
from kickmill.functions import names as N
from kickmill.functions import odds as O
from kickmill.functions import parse as P
from kickmill.markets import BOOKMAKERS, MARKETS, mangled, odds_col, odds_columns
from kickmill.operators import backtest as B
from kickmill.operators import dataset as D
from kickmill.operators import evidence as E
from kickmill.operators import features as X
from kickmill.operators import frame as R
from kickmill.operators import goalmodel as GM
from kickmill.operators import mapping as MP
from kickmill.operators import metrics as M
from kickmill.operators import reconcile as RC
from kickmill.operators import rolling as RW
from kickmill.operators import splits as S
from kickmill.operators import similar as SM
from kickmill.operators import tabular as T
from kickmill.operators import validate as V
from kickmill.plans import league as LG
from kickmill.session import shared_folder
from kickmill.sources import readers as RD
from kickmill.sources import store as ST
from kickmill.streaming import ingest as SI

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(r6(c).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CTE = "WITH " + LG.FRAME_CTE
SEL = {m: meta["selections"] for m, meta in MARKETS.items()}


def o6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# --- scans, lookups, store ---------------------------------------------------------------------------


@query(f"{CTE} SELECT match_id, league_key, match_date, CAST(ft_home AS BIGINT) AS ft_home, CAST(ft_away AS BIGINT) AS ft_away, (ht_home IS NOT NULL AND ht_away IS NOT NULL) AS has_ht, {', '.join(o6(c, c) for c in odds_columns())} FROM f")
def read_model(spark, sf_dir):
    return rounded(LG.flat(spark, sf_dir).select("match_id", "league_key", "match_date", "ft_home", "ft_away", "has_ht", *odds_columns()))


@query(f"{CTE} SELECT match_id, league_key FROM m WHERE ft_home IS NOT NULL AND ft_away IS NOT NULL")
def completed_matches(spark, sf_dir):
    return R.completed(LG.matches(spark, sf_dir)).select("match_id", "league_key")


_PROBE = "SELECT DISTINCT league_key, home_team_id, away_team_id, {day} AS match_date FROM m"


@query(f"{CTE}, probe AS ({_PROBE.format(day='match_date + CAST(match_id % 2 AS INTEGER)')}) SELECT m.match_id FROM m JOIN probe USING (league_key, home_team_id, away_team_id, match_date)")
def pairing_date_lookup(spark, sf_dir):
    """Every match's pairing is looked up, for odd ids on the day after."""
    m = LG.matches(spark, sf_dir)
    probe = m.withColumn("match_date", F.date_add("match_date", (F.col("match_id") % 2).cast("int")))
    return ST.find_by_pairing_date(m, probe).select("match_id")


@query("SELECT o_orderkey AS number, c.c_custkey AS id, c.c_name AS name FROM (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 100000000 ELSE 0 END AS k FROM orders) o LEFT JOIN customer c ON c.c_custkey = o.k")
def key_lookup(spark, sf_dir):
    """A batch of point reads: an order's customer, or nulls."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 100000000).otherwise(0)).alias("key"))
    found = ST.lookup(stored, o.select("key").distinct())
    return o.join(found, "key").select("number", "id", "name")


@query("SELECT o_orderkey AS id, o_custkey AS league_id, CAST(o_orderdate AS DATE) AS match_date, CASE WHEN o_orderkey % 4 = 0 THEN 'moved' ELSE 'completed' END AS status FROM orders WHERE o_orderkey % 10 <> 0 ORDER BY 1")
def committed_units(spark, sf_dir):
    """Three units of work on a new store: two add orders as matches, one updates; a fourth is rolled back and never seen."""
    store = ST.open_store(spark, f"{shared_folder(spark).rstrip('/')}/kickmill-store-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("league_key"), F.col("o_orderdate").cast("date").alias("match_date"), F.lit("completed").alias("status"))
    for rest in (F.col("id") % 10 < 5, F.col("id") % 10 >= 5):
        with ST.Unit(store) as unit:
            unit.add("matches", rows.filter(rest & (F.col("id") % 10 != 0)))
            unit.commit()
    with ST.Unit(store) as unit:
        unit.update("matches", unit.tables["matches"].filter("id % 4 = 0").select("id", F.lit("moved").alias("status")))
        unit.commit()
    with ST.Unit(store) as unit:
        unit.add("matches", rows.filter("id % 10 = 0"))
    return store.tables()["matches"].select("id", F.col("league_key").cast("long").alias("league_id"), "match_date", "status")


@query("""SELECT 'matches' AS section, NULL AS name, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'odds_quotes', NULL, count(*) FROM lineitem
UNION ALL SELECT 'league', CASE WHEN p IN ('1', '2') THEN concat('League ', p) ELSE p END, count(*) FROM (SELECT substr(o_orderpriority, 1, 1) AS p FROM orders) GROUP BY p
UNION ALL SELECT concat('rows_', unnest(['imported', 'duplicate', 'enriched', 'rejected'])), n_name, unnest([n_regionkey, n_regionkey + 1, 0, 2]) FROM nation""")
def database_summary(spark, sf_dir):
    leagues = spark.createDataFrame([(1, "1", "League 1"), (2, "2", "League 2")], "id long, canonical_key string, name string")
    imports = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("filename"), F.col("n_regionkey").alias("rows_imported"), (F.col("n_regionkey") + 1).alias("rows_duplicate"), F.lit(0).cast("long").alias("rows_enriched"), F.lit(2).cast("long").alias("rows_rejected"))
    return ST.database_summary({"matches": LG.matches(spark, sf_dir), "odds": table(spark, sf_dir, "lineitem"), "leagues": leagues, "imports": imports})


@query("SELECT o_orderpriority AS league_key, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def count_by_league(spark, sf_dir):
    return ST.count_by_league(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "league_key"))


@query("SELECT o_custkey AS custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS id, o_orderkey AS orderkey FROM orders")
def appended_ids(spark, sf_dir):
    stored = spark.createDataFrame([(1000, -1, -1)], "id long, custkey long, orderkey long")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_orderdate")
    return ST.appended(stored, new, ["o_orderdate", "orderkey"]).filter("orderkey >= 0")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'final' ELSE o_orderstatus END AS status, o_custkey AS custkey FROM orders")
def updated_rows(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey"))
    changes = stored.filter("id % 5 = 0").select("id", F.lit("final").alias("status"))
    return ST.updated(stored, changes)


@query("SELECT n_nationkey AS id, n_name AS filename FROM nation ORDER BY id DESC")
def import_history(spark, sf_dir):
    return ST.import_history(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("filename")))


@query(f"{CTE} SELECT match_id, league_key, league_name FROM m")
def league_join(spark, sf_dir):
    m = LG.matches(spark, sf_dir).select("match_id", F.col("league_key").cast("long").alias("league_id"))
    leagues = spark.range(1, 6).select("id", F.col("id").cast("string").alias("canonical_key"), F.concat(F.lit("League "), F.col("id").cast("string")).alias("name"))
    return R.with_leagues(m, leagues).select("match_id", "league_key", "league_name")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_index, CAST(c_custkey AS VARCHAR) AS Div, concat('Köln ', c_name) AS HomeTeam, c_mktsegment AS AwayTeam FROM customer")
def season_csv(spark, sf_dir):
    """Customers written as Latin-1 files with semicolons and blanks around their headers, and read by ranges in order of the files."""
    path = f"{shared_folder(spark).rstrip('/')}/kickmill-{uuid.uuid4().hex}.csv"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Köln "), "c_name").alias("name"), "c_mktsegment")
    rows.orderBy("c_custkey").toDF(" Div", "HomeTeam ", " AwayTeam ").write.csv(path, header=True, sep=";", encoding="ISO-8859-1")
    return RD.read_table(spark, path).select("row_index", "Div", "HomeTeam", "AwayTeam")


# --- parsing and validation --------------------------------------------------------------------------

RAW_SQL = f"""{CTE}, raw AS (
  SELECT match_id * 2 AS row_index, match_id AS k, CASE WHEN match_id % 29 <> 0 THEN concat('E', league_key) END AS league_raw,
    CASE WHEN match_id % 31 <> 0 THEN match_date END AS match_date, kickoff_time,
    CASE WHEN match_id % 37 <> 0 THEN concat('Team ', home_team_id) END AS home_raw,
    CASE WHEN match_id % 41 = 0 THEN concat('team ', home_team_id) ELSE concat('Team ', away_team_id) END AS away_raw,
    CASE WHEN match_id % 43 <> 0 THEN ft_home END AS fth, ft_away AS fta,
    CASE WHEN match_id % 17 = 0 THEN 9 ELSE ht_home END AS hth, CASE WHEN match_id % 19 <> 0 THEN ht_away END AS hta,
    odds_1x2_home_bet365 AS h, odds_1x2_draw_bet365 AS d, CASE WHEN match_id % 23 = 0 THEN 0.5 ELSE odds_1x2_away_bet365 END AS a,
    odds_ou_2_5_over_market_avg AS ov, odds_ou_2_5_under_market_avg AS un FROM f),
val AS (
  SELECT *, CASE WHEN home_raw IS NULL OR away_raw IS NULL THEN 'missing team name' WHEN lower(home_raw) = lower(away_raw) THEN 'identical teams'
      WHEN match_date IS NULL THEN 'bad date' WHEN fth IS NULL OR fta IS NULL THEN 'bad full-time score' END AS error,
    ((hth IS NULL) <> (hta IS NULL)) AS partial, coalesce(hth > fth OR hta > fta, false) AS impossible FROM raw)"""


@query(RAW_SQL + " SELECT row_index, error, match_date, kickoff_time, CAST(fth AS INTEGER) AS ft_home, CAST(fta AS INTEGER) AS ft_away, CASE WHEN NOT partial AND NOT impossible THEN CAST(hth AS INTEGER) END AS ht_home, CASE WHEN NOT partial AND NOT impossible THEN CAST(hta AS INTEGER) END AS ht_away, league_raw FROM val")
def validated_rows(spark, sf_dir):
    v = V.validate(LG.season_file(spark, sf_dir), MP.SEASON_FILES)
    return v.select("row_index", "error", "match_date", "kickoff_time", "ft_home", "ft_away", "ht_home", "ht_away", "league_raw")


#: A file layout as users write it, and the season file's columns under its names.
CLUB_PROFILE = """{"name": "club_file", "source_name": "club", "date_col": "Datum", "home_col": "Heim", "away_col": "Gast", "fthg_col": "T1", "ftag_col": "T2", "hthg_col": "H1", "htag_col": "H2", "time_col": "Zeit", "league_col": "Liga",
  "odds_columns": {"Q1": {"bookmaker": "bet365", "market": "1x2", "selection": "home"}, "QX": {"bookmaker": "bet365", "market": "1x2", "selection": "draw"}, "Q2": {"bookmaker": "bet365", "market": "1x2", "selection": "away"}}}"""
CLUB_COLUMNS = {"Date": "Datum", "HomeTeam": "Heim", "AwayTeam": "Gast", "FTHG": "T1", "FTAG": "T2", "HTHG": "H1", "HTAG": "H2", "Time": "Zeit", "Div": "Liga", "B365H": "Q1", "B365D": "QX", "B365A": "Q2"}


@query(RAW_SQL + """ SELECT row_index, CAST(fth AS INTEGER) AS ft_home, CAST(fta AS INTEGER) AS ft_away, CAST(coalesce((h >= 1.01)::INT, 0) + coalesce((d >= 1.01)::INT, 0) + coalesce((a >= 1.01)::INT, 0) AS BIGINT) AS n_odds,
  league_raw, 'club_file' AS profile, CAST(1.0 AS DOUBLE) AS score FROM val WHERE error IS NULL""")
def custom_profile(spark, sf_dir):
    """The season file under other names, recognised and read by a profile from its JSON text."""
    raw = LG.season_file(spark, sf_dir).withColumnsRenamed(CLUB_COLUMNS)
    profile, score = MP.detect_profile([c for c in raw.columns if c != "row_index"], [*MP.PROFILES, MP.parse_profile(CLUB_PROFILE)])
    v = V.validate(raw, profile).filter("error IS NULL")
    return v.select("row_index", "ft_home", "ft_away", F.size("odds").cast("long").alias("n_odds"), "league_raw", F.lit(profile.name).alias("profile"), F.lit(float(score)).alias("score"))


@query(RAW_SQL + """, q AS (
  SELECT row_index, 'bet365' AS bookmaker, '1x2' AS market, unnest(['home', 'draw', 'away']) AS selection, unnest([h, d, a]) AS price FROM val WHERE error IS NULL
  UNION ALL SELECT row_index, 'market_avg', 'ou_2.5', unnest(['over', 'under']), unnest([ov, un]) FROM val WHERE error IS NULL)
SELECT row_index, bookmaker, market, selection, round(price, 6) AS decimal_odds FROM q WHERE price >= 1.01""")
def unpivoted_quotes(spark, sf_dir):
    v = V.unpivoted(V.validate(LG.season_file(spark, sf_dir), MP.SEASON_FILES))
    return v.select("row_index", "bookmaker", "market", "selection", F.round("decimal_odds", 6).alias("decimal_odds"))


@query(RAW_SQL + """ SELECT row_index, CAST((partial OR impossible)::INT + coalesce((h < 1.01)::INT, 0) + coalesce((d < 1.01)::INT, 0) + coalesce((a < 1.01)::INT, 0) + coalesce((ov < 1.01)::INT, 0) + coalesce((un < 1.01)::INT, 0)
  + coalesce((h >= 1.01 AND d >= 1.01 AND a >= 1.01 AND (1 / h + 1 / d + 1 / a < 1.0 OR 1 / h + 1 / d + 1 / a > 1.25))::INT, 0) AS BIGINT) AS n_warnings FROM val WHERE error IS NULL""")
def validation_warnings(spark, sf_dir):
    v = V.validate(LG.season_file(spark, sf_dir), MP.SEASON_FILES).filter("error IS NULL")
    return v.select("row_index", F.size("warnings").cast("long").alias("n_warnings"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS INTEGER) END AS whole, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS number FROM part""")
def parsed_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0 ")))
    price = F.when(F.col("p_size") % 7 == 0, "nan").otherwise(F.col("p_retailprice").cast("string"))
    return p.select("p_partkey", P.whole_number(text).alias("whole"), P.number(price).alias("number"))


#: Layouts in which a date is written, and what else stands there.
FREE_FORMS = {"long_name": ("d MMMM yyyy", "", ""), "short_name": ("dd-MMM-yy", "", ""), "name_first": ("MMM d, yyyy", "", ""), "year_first": ("yyyy/MM/dd", "", ""), "digits": ("yyyyMMdd", "", ""), "instant": ("yyyy-MM-dd", "", "T14:30:00Z"), "with_day": ("EEEE d MMM yyyy", "", " 2pm"), "ordinal": ("MMMM yyyy", "11th ", "")}


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS four_digit, CAST(o_orderdate AS DATE) AS two_digit, CAST(o_orderdate AS DATE) AS month_first, CAST(NULL AS DATE) AS bad, "
       + ", ".join(f"CAST({'date_trunc(chr(109) || chr(111) || chr(110) || chr(116) || chr(104), o_orderdate) + INTERVAL 10 DAY' if n == 'ordinal' else 'o_orderdate'} AS DATE) AS {n}" for n in FREE_FORMS)
       + ", printf('%02d:%02d', o_orderkey % 24, o_orderkey % 60) AS dotted, printf('%02d:00', o_orderkey % 24) AS halves, printf('%02d:%02d', o_orderkey % 24, o_orderkey % 60) AS instant_time FROM orders")
def parsed_dates(spark, sf_dir):
    """Dates and times in known layouts and in free form."""
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    h, m = (F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0") for n in (24, 60))
    free = [P.day(F.concat(F.lit(before), F.date_format(d, layout), F.lit(behind))).alias(n) for n, (layout, before, behind) in FREE_FORMS.items()]
    hour = F.col("o_orderkey") % 24
    times = [P.time_of_day(F.concat(h, F.lit("."), m)).alias("dotted"), P.time_of_day(F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.when(hour < 12, " AM").otherwise("pm"))).alias("halves"), P.time_of_day(F.concat(F.lit("2024-01-31T"), h, F.lit(":"), m, F.lit(":59.5+01:00"))).alias("instant_time")]
    return o.select("o_orderkey", P.day(F.date_format(d, "dd/MM/yyyy")).alias("four_digit"), P.day(F.date_format(d, "dd/MM/yy")).alias("two_digit"), P.day(F.date_format(d, "MM/dd/yyyy"), dayfirst=False).alias("month_first"), P.day(F.concat(F.lit("x"), d.cast("string"))).alias("bad"), *free, *times)


@query(f"{CTE} SELECT match_id, concat(league_key, '|', home_team_id, '|', away_team_id, '|', match_date, '|', coalesce(strftime(((match_date + kickoff_time::TIME) AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC', '%H:%M'), 'NA')) AS dedupe_key FROM m")
def dedupe_keys(spark, sf_dir):
    m = LG.matches(spark, sf_dir)
    kickoff = P.kickoff_utc(F.col("match_date"), F.col("kickoff_time"))
    return m.select("match_id", P.dedupe_key(F.col("league_key"), F.col("home_team_id"), F.col("away_team_id"), F.col("match_date"), kickoff).alias("dedupe_key"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(concat(p_name, ' (', p_brand, ')')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalized_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.normalized(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


_HEADERS = {"everything": (0, 39), "core": (0, 0), "half": (0, 20), "no date": (1, 39), "no teams": (3, 0), "nothing": (6, 0)}
_ODDS_NAMES = list(MP.SEASON_FILES.odds_columns)
_CORE_NAMES = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "Div"]


@query(f"""WITH core AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_CORE_NAMES))}) AS t(i, c)),
h AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}, {b})" for n, (a, b) in _HEADERS.items())}) AS t(header, gone, odds)),
x AS (SELECT header, odds, gone, (SELECT count(*) FROM core WHERE i >= gone) AS found, (SELECT string_agg(c, ',' ORDER BY i) FROM core WHERE i < gone) AS missing FROM h)
SELECT header, coalesce(missing, '') AS missing, round(CASE WHEN found < 6 THEN 0.4::DOUBLE * found / 6 ELSE 0.7::DOUBLE + 0.3::DOUBLE * odds / 39 END, 6) AS score, CASE WHEN found > 0 THEN 'football-data.co.uk' END AS detected, found = 6 AS auto_apply FROM x""")
def profile_fit(spark, sf_dir):
    """Headers of several files held against the season profile: core columns left out, odds columns found."""
    rows = []
    for name, (gone, odds) in _HEADERS.items():
        header = [*MP.core_columns(MP.SEASON_FILES)[gone:], *(f" {c}" for c in _ODDS_NAMES[:odds])]
        best, score = MP.detect_profile(header)
        rows.append((name, ",".join(MP.fit(MP.SEASON_FILES, header).missing), round(score, 6), best and best.name, score >= MP.AUTO_APPLY))
    return spark.createDataFrame(rows, "header string, missing string, score double, detected string, auto_apply boolean")


# --- import ------------------------------------------------------------------------------------------


def _empty_store(spark):
    return {n: spark.createDataFrame([], s) for n, s in ST.SCHEMAS.items()}


def _rules_sql(rows: str) -> str:
    """What becomes of rows (row_index, g: pairing and day, t: time or null, x: score) in row order: r(row_index, outcome)."""
    return f"""k AS (SELECT row_index, g, x, coalesce(t, 'NA') AS t, row_number() OVER (PARTITION BY g ORDER BY row_index) AS i FROM ({rows})),
r AS (
  SELECT g, i, row_index, 'imported' AS outcome, [{{'t': t, 'x': x}}] AS st FROM k WHERE i = 1 UNION ALL
  SELECT g, i, row_index, outcome, CASE outcome WHEN 'imported' THEN list_append(st, {{'t': t, 'x': x}}) WHEN 'enriched' THEN [{{'t': t, 'x': st[1].x}}] ELSE st END FROM (
    SELECT k.g, k.i, k.row_index, k.t, k.x, r.st,
      CASE WHEN len(list_filter(r.st, lambda s: s.t = k.t)) > 0 THEN CASE WHEN list_filter(r.st, lambda s: s.t = k.t)[1].x = k.x THEN 'duplicate' ELSE 'conflict' END
        WHEN k.t <> 'NA' AND len(r.st) = 1 AND r.st[1].t = 'NA' THEN 'enriched' WHEN k.t <> 'NA' THEN 'imported' ELSE 'duplicate' END AS outcome
    FROM r JOIN k ON k.g = r.g AND k.i = r.i + 1))"""


_COUNTS = "CAST(count(*) AS BIGINT) AS rows_total, " + ", ".join(f"CAST(count_if(outcome = '{k}') AS BIGINT) AS rows_{k}" for k in ("imported", "duplicate", "enriched")) + ", CAST(count_if(outcome NOT IN ('imported', 'duplicate', 'enriched')) AS BIGINT) AS rows_rejected"
_COUNTED = ["rows_total", "rows_imported", "rows_duplicate", "rows_enriched", "rows_rejected"]
_SEASON = RAW_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _rules_sql("SELECT row_index, concat(league_raw, '|', home_raw, '|', away_raw, '|', match_date) AS g, kickoff_time AS t, fth * 10 + fta AS x FROM val WHERE error IS NULL AND league_raw IS NOT NULL") + """,
o AS (SELECT row_index, outcome FROM r UNION ALL SELECT row_index, coalesce(error, 'no league') FROM val WHERE error IS NOT NULL OR league_raw IS NULL)"""


def _season_import(spark, sf_dir):
    """The whole season file against an empty store, with team names that are not alike."""
    raw = LG.season_file(spark, sf_dir)
    for c in ("HomeTeam", "AwayTeam"):
        raw = raw.withColumn(c, F.when(F.col(c).isNotNull(), F.repeat(F.char(97 + F.regexp_extract(c, r"\d+", 0).cast("int")), F.lit(6))))
    return RC.import_rows(V.validate(raw, MP.SEASON_FILES), MP.SEASON_FILES, _empty_store(spark))["outcomes"]


@query(_SEASON + " SELECT row_index, outcome FROM o")
def import_outcomes(spark, sf_dir):
    """What became of every row of the season file, faulty ones included."""
    return _season_import(spark, sf_dir).select("row_index", "outcome")


@query(_SEASON + f""", s AS (SELECT sum((h >= 1.01)::INT + (d >= 1.01)::INT + (a >= 1.01)::INT) AS n FROM val JOIN r USING (row_index) WHERE outcome = 'imported' AND h IS NOT NULL),
t AS (SELECT sum((ov >= 1.01)::INT + (un >= 1.01)::INT) AS n FROM val JOIN r USING (row_index) WHERE outcome = 'imported' AND ov IS NOT NULL)
SELECT {_COUNTS}, CAST((SELECT n FROM s) + (SELECT n FROM t) AS BIGINT) AS odds_quotes_stored FROM o""")
def import_report(spark, sf_dir):
    return RC.import_report(_season_import(spark, sf_dir)).select(*_COUNTED, "odds_quotes_stored")


_RULES = f"""WITH RECURSIVE {LG.FRAME_CTE}, """ + _rules_sql("SELECT match_id * 2 AS row_index, concat(league_key, '|', home_team_id % 3, '|', away_team_id % 3, '|', date_trunc('month', match_date)::DATE) AS g, CASE WHEN match_id % 3 <> 0 THEN concat(12 + match_id % 2, ':30') END AS t, match_id % 2 AS x FROM m")


def _dense_import(spark, sf_dir):
    return RC.import_rows(V.validate(LG.dense_file(spark, sf_dir), MP.SEASON_FILES), MP.SEASON_FILES, _empty_store(spark))


@query(_RULES + " SELECT row_index, outcome FROM r")
def import_rules(spark, sf_dir):
    """Many rows of the same pairing and day, some without a time: imported, duplicate, enriched or in conflict, in row order."""
    return _dense_import(spark, sf_dir)["outcomes"].select("row_index", "outcome")


@query(_RULES + f" SELECT {_COUNTS} FROM r")
def import_counts(spark, sf_dir):
    return RC.import_report(_dense_import(spark, sf_dir)["outcomes"]).select(*_COUNTED)


@query("""WITH n AS (SELECT p_partkey AS row_index, chr(CAST(97 + p_partkey % 20 AS INTEGER)) AS c FROM part), f AS (SELECT c, min(row_index) AS first FROM n GROUP BY c)
SELECT repeat(c, 6) AS normal, CASE WHEN ascii(c) < 103 THEN 'exact' WHEN ascii(c) < 107 THEN 'alias' WHEN c = 't' THEN 'fuzzy' ELSE 'created' END AS kind,
  CASE WHEN ascii(c) < 103 THEN repeat(c, 6) WHEN ascii(c) < 107 THEN repeat(c, 6) WHEN c = 't' THEN 'tttttu' ELSE repeat(c, 6) END AS matched_key,
  CAST(CASE WHEN ascii(c) < 103 THEN ascii(c) WHEN ascii(c) < 107 THEN 97 WHEN c = 't' THEN 500 ELSE 500 + row_number() OVER (PARTITION BY ascii(c) BETWEEN 107 AND 115 ORDER BY first) END AS BIGINT) AS team_id FROM f""")
def team_resolution(spark, sf_dir):
    """Names of parts against stored teams and aliases: known, known otherwise, similar, new in order of first sight."""
    c = F.char(97 + F.col("p_partkey") % 20)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.upper(F.repeat(c, F.lit(6))).alias("home_raw"), F.repeat(c, F.lit(6)).alias("away_raw"), F.lit("E0").alias("league_key"), F.lit(None).cast("string").alias("error"))
    teams = spark.createDataFrame([(i, chr(i) * 6, chr(i) * 6) for i in range(97, 103)] + [(500, "Tttttu", "tttttu")], "id long, canonical_name string, normalized_key string")
    aliases = spark.createDataFrame([(i, 97, chr(i) * 6, 1.0) for i in range(103, 107)], "id long, team_id long, normalized_alias string, confidence double")
    return RC.resolve_teams(rows, teams, aliases, 0.8)[1].select("normal", "kind", "matched_key", "team_id")


def _client_names(spark, sf_dir):
    """Normal forms of all clients' names; (row, side) is the order in which they are first seen."""
    c = table(spark, sf_dir, "clients").select(F.col("client_id").alias("row_index"), F.lit(0).alias("side"), F.col("name").alias("raw"))
    return c.filter("raw IS NOT NULL AND row_index IS NOT NULL").withColumn("normal", N.normalized(F.col("raw")))


@query()
def similar_names(spark, sf_dir):
    """All pairs of different client names, in normal form, with a ratio of at least 0.92."""
    names = _client_names(spark, sf_dir).select(F.col("normal").alias("name"))
    return SM.similar_pairs(names, names, 0.92).select("name", "candidate", F.round("similarity", 6).alias("similarity"), "recorded")


@query()
def client_resolution(spark, sf_dir):
    """All client names in order of client: known as a vendor's, like a vendor's or an earlier client's, or new."""
    vendors = table(spark, sf_dir, "vendors").filter("name IS NOT NULL").select(F.col("vendor_id").alias("id"), N.normalized(F.col("name")).alias("normalized_key"))
    aliases = spark.createDataFrame([], "team_id long, normalized_alias string, confidence double")
    return RC.resolve_names(_client_names(spark, sf_dir), vendors, aliases).select("normal", "kind", "matched_key", "team_id", "confidence")


@query(f"""{CTE}, q AS (SELECT match_id, unnest(['home', 'draw', 'away']) AS selection, unnest([odds_1x2_home_bet365, odds_1x2_draw_bet365, odds_1x2_away_bet365]) AS price FROM f WHERE odds_1x2_home_bet365 IS NOT NULL)
SELECT match_id * 2 AS row_index, selection, round(price, 6) AS decimal_odds FROM q WHERE match_id % 3 <> 0 AND selection <> 'home'""")
def backfilled_odds(spark, sf_dir):
    """A second import of stored matches: home prices are there already, for each third match all; only the rest is added, what differs is kept as stored."""
    m = LG.matches(spark, sf_dir).select("match_id", "league_key", F.col("match_id").alias("home_team_id"), (-F.col("match_id")).alias("away_team_id"), "match_date", "ft_home", "ft_away")
    key = P.dedupe_key(F.col("league_key"), F.col("home_team_id"), F.col("away_team_id"), F.col("match_date"), F.lit(None).cast("timestamp_ntz"))
    quotes = LG.odds(spark, sf_dir).filter("market = '1x2' AND bookmaker = 'bet365' AND price_point IS NULL")
    rows = m.join(quotes.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("bookmaker", "market", "selection", F.round("decimal_odds", 6).alias("decimal_odds"), "line", "price_point"))).alias("odds")), "match_id")
    rows = rows.select((F.col("match_id") * 2).alias("row_index"), F.concat_ws("|", "league_key", "home_team_id", "away_team_id", F.col("match_date").cast("string")).alias("pairing"), "league_key", "home_team_id", "away_team_id", "match_date", F.lit(None).cast("timestamp_ntz").alias("kickoff_utc"), "ft_home", "ft_away", F.lit(None).cast("int").alias("ht_home"), F.lit(None).cast("int").alias("ht_away"), key.alias("dedupe_key"), F.lit(None).cast("string").alias("external_id"), F.expr("cast(array() as array<string>)").alias("warnings"), "odds")
    stored = m.select(F.col("match_id").alias("id"), "league_key", "home_team_id", "away_team_id", "match_date", F.lit(None).cast("timestamp_ntz").alias("kickoff_utc"), "ft_home", "ft_away", key.alias("dedupe_key"))
    held = quotes.filter("match_id % 3 = 0 OR selection = 'home'").withColumn("decimal_odds", F.col("decimal_odds") + F.when(F.col("match_id") % 2 == 0, 1.0).otherwise(0.0))
    done = RC.act(rows, _empty_store(spark) | {"matches": stored, "odds": held}, "test", 10**12)
    return done.select("row_index", F.explode("new_odds").alias("q")).select("row_index", "q.selection", "q.decimal_odds")


@query("""WITH n AS (SELECT c_custkey AS k, c_custkey // 2000 AS block, c_custkey % 2000 AS i FROM customer)
SELECT k AS row_index, min(k) OVER (PARTITION BY block) AS first_row FROM n""")
def linked_external_ids(spark, sf_dir):
    """Customers as rows of chains of 1,000 pairings: each shares its pairing with the row before or its external id with the row behind."""
    i, block = F.col("c_custkey") % 2000, F.floor(F.col("c_custkey") / 2000)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), F.concat_ws("|", block, F.floor((i + 1) / 2)).alias("pairing"), F.concat_ws("#", block, F.floor(i / 2)).alias("external_id"))
    groups = RC.linked_groups(rows)
    return groups.join(groups.groupBy("group").agg(F.min("row_index").alias("first_row")), "group").select("row_index", "first_row")


@query("""SELECT c_custkey AS row_index, CASE WHEN c_custkey // 3 % 4 > 0 AND c_custkey % 3 = 0 THEN 'imported' ELSE 'duplicate' END AS outcome,
  CASE WHEN c_custkey // 3 % 4 = 0 THEN -(c_custkey // 3) ELSE 1000000000001 + c_custkey - c_custkey % 3 END AS match_id FROM customer WHERE c_custkey >= 3""")
def external_ids(spark, sf_dir):
    """Customers as rows, three to an external id: the first is imported and links it, another day's row follows it, so does the third; a fourth of the ids is stored."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter(k >= 3).select(
        k.alias("row_index"), F.concat_ws("|", F.floor(k / 3), F.when(k % 3 == 2, "later").otherwise("first")).alias("pairing"), F.lit("E0").alias("league_key"), F.floor(k / 3).alias("home_team_id"), (k % 3).alias("away_team_id"), F.lit(None).cast("date").alias("match_date"),
        F.lit(None).cast("timestamp_ntz").alias("kickoff_utc"), F.lit(1).alias("ft_home"), F.lit(0).alias("ft_away"), F.lit(None).cast("int").alias("ht_home"), F.lit(None).cast("int").alias("ht_away"), F.concat_ws("|", F.floor(k / 3), F.when(k % 3 == 2, "later").otherwise("first")).alias("dedupe_key"),
        F.concat(F.lit("id"), F.floor(k / 3)).alias("external_id"), F.expr("cast(array() as array<string>)").alias("warnings"), F.expr("cast(array() as array<struct<bookmaker:string,market:string,selection:string,decimal_odds:double,line:double,price_point:string>>)").alias("odds"))
    held = rows.filter(F.floor(F.col("row_index") / 3) % 4 == 0).select(F.lit("test").alias("source"), "external_id", (-F.floor(F.col("row_index") / 3)).alias("match_id")).distinct()
    return RC.act(rows, _empty_store(spark) | {"sources": held}, "test", 10**12).select("row_index", "outcome", "match_id")


# --- labels, prices, margin --------------------------------------------------------------------------


@query(f"""{CTE} SELECT match_id, CASE WHEN ft_home > ft_away THEN 'home' WHEN ft_home = ft_away THEN 'draw' ELSE 'away' END AS target_1x2,
  CASE WHEN ft_home + ft_away > 2.5 THEN 'over' ELSE 'under' END AS target_ou_2_5, CASE WHEN ft_home > 0 AND ft_away > 0 THEN 'yes' ELSE 'no' END AS target_btts,
  CASE WHEN ht_home IS NOT NULL AND ht_away IS NOT NULL THEN concat(CASE WHEN ht_home > ht_away THEN '1' WHEN ht_home = ht_away THEN 'X' ELSE '2' END, '/', CASE WHEN ft_home > ft_away THEN '1' WHEN ft_home = ft_away THEN 'X' ELSE '2' END) END AS target_htft FROM m""")
def match_labels(spark, sf_dir):
    return D.with_labels(LG.matches(spark, sf_dir)).select("match_id", "target_1x2", "target_ou_2_5", "target_btts", "target_htft")


RAW3 = "CASE WHEN odds_1x2_home_bet365 >= 1.01 AND odds_1x2_draw_bet365 >= 1.01 AND odds_1x2_away_bet365 >= 1.01 THEN"
P3 = [f"{RAW3} 1 / odds_1x2_{s}_bet365 END" for s in SEL["1x2"]]


def _raw(book="bet365", market="1x2"):
    return O.raw_probabilities(*[F.col(odds_col(market, s, book)) for s in SEL[market]])


def _fair(spark, sf_dir, method):
    f = LG.flat(spark, sf_dir).withColumn("_f", O.devig(method, _raw()))
    return f.select("match_id", *[r6(F.get("_f", F.lit(i))).alias(f"p_{s}") for i, s in enumerate(SEL["1x2"])])


@query(f"{CTE}, p AS (SELECT match_id, {', '.join(f'{e} AS p{i}' for i, e in enumerate(P3))} FROM f) SELECT match_id, {', '.join(o6(f'p{i}', f'imp_{s}') for i, s in enumerate(SEL['1x2']))}, {o6('p0 + p1 + p2 - 1', 'overround')} FROM p")
def implied_overround(spark, sf_dir):
    f = LG.flat(spark, sf_dir).withColumn("_r", _raw())
    return f.select("match_id", *[r6(F.get("_r", F.lit(i))).alias(f"imp_{s}") for i, s in enumerate(SEL["1x2"])], r6(O.overround(F.col("_r"))).alias("overround"))


@query(f"{CTE}, p AS (SELECT match_id, {', '.join(f'{e} AS p{i}' for i, e in enumerate(P3))} FROM f) SELECT match_id, {', '.join(o6(f'p{i} / (p0 + p1 + p2)', f'p_{s}') for i, s in enumerate(SEL['1x2']))} FROM p")
def devig_proportional(spark, sf_dir):
    return _fair(spark, sf_dir, "proportional")


def _bisection_sql(f_low: str, low: str, high: str, f_mid: str, fair: str) -> str:
    return f"""WITH RECURSIVE {LG.FRAME_CTE}, p AS (SELECT match_id, {', '.join(f'{e} AS p{i}' for i, e in enumerate(P3))} FROM f),
d AS (SELECT DISTINCT p0, p1, p2, p0 + p1 + p2 AS s FROM p WHERE p0 IS NOT NULL),
it AS (SELECT p0, p1, p2, s, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi, 0 AS i FROM d
  UNION ALL SELECT p0, p1, p2, s, CASE WHEN {f_mid} > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {f_mid} > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM it WHERE i < 60),
r AS (SELECT p0, p1, p2, s, (lo + hi) / 2 AS z FROM it WHERE i = 60),
q AS (SELECT p0, p1, p2, {', '.join(fair.replace('P', f'p{i}') + f' AS q{i}' for i in range(3))} FROM r)
SELECT match_id, {', '.join(o6(f'q{i} / (q0 + q1 + q2)', f'p_{s}') for i, s in enumerate(SEL['1x2']))} FROM p LEFT JOIN q USING (p0, p1, p2)"""


_MID = "((lo + hi) / 2)"


@query(_bisection_sql("", "1", "10", f"(pow(p0, {_MID}) + pow(p1, {_MID}) + pow(p2, {_MID}) - 1)", "pow(P, z)"))
def devig_power(spark, sf_dir):
    return _fair(spark, sf_dir, "power")


def _shin_sql(p: str, z: str) -> str:
    return f"((sqrt({z} * {z} + 4 * (1 - {z}) * {p} * {p} / s) - {z}) / (2 * (1 - {z})))"


@query(_bisection_sql("", "0", "0.999", "(" + " + ".join(_shin_sql(f"p{i}", _MID) for i in range(3)) + " - 1)", _shin_sql("P", "z")))
def devig_shin(spark, sf_dir):
    return _fair(spark, sf_dir, "shin")


@query(f"{CTE} SELECT match_id, {', '.join(o6(f'coalesce(odds_1x2_{s}_bet365, odds_1x2_{s}_market_avg)', f'o_{s}') for s in SEL['1x2'])} FROM f")
def best_odds(spark, sf_dir):
    return LG.flat(spark, sf_dir).select("match_id", *[r6(c).alias(f"o_{s}") for s, c in R.best_odds("1x2").items()])


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def _fair_ctes(market: str, book: str) -> str:
    """Raw, power and Shin probabilities of a market and book: x_<market>_<book>(match_id, p<i>, w<i>, n<i>)."""
    n, k = len(SEL[market]), f"{mangled(market)}_{book}"
    cols = [odds_col(market, s, book) for s in SEL[market]]
    ps = [f"p{i}" for i in range(n)]
    halve = lambda name, low, high, f: f"""{name}_{k} AS (SELECT {', '.join(ps)}, s, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi, 0 AS i FROM d_{k}
  UNION ALL SELECT {', '.join(ps)}, s, CASE WHEN {f} > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {f} > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM {name}_{k} WHERE i < 60)"""  # noqa: E731
    end = lambda name: f"(SELECT {', '.join(ps)}, s, (lo + hi) / 2 AS z FROM {name}_{k} WHERE i = 60)"
    scaled = lambda es, to: ", ".join(f"{e} / {_sum(es)} AS {to}{i}" for i, e in enumerate(es))
    return f"""p_{k} AS (SELECT match_id, {', '.join(f'CASE WHEN {" AND ".join(f"{c} >= 1.01" for c in cols)} THEN 1 / {c} END AS p{i}' for i, c in enumerate(cols))} FROM f),
d_{k} AS (SELECT DISTINCT {', '.join(ps)}, {_sum(ps)} AS s FROM p_{k} WHERE p0 IS NOT NULL),
{halve('pw', 1, 10, f"({_sum(f'pow({p}, {_MID})' for p in ps)} - 1)")},
{halve('sh', 0, 0.999, f"({_sum(_shin_sql(p, _MID) for p in ps)} - 1)")},
w_{k} AS (SELECT {', '.join(ps)}, {scaled([f'pow({p}, z)' for p in ps], 'w')} FROM {end('pw')}),
n_{k} AS (SELECT {', '.join(ps)}, {scaled([_shin_sql(p, 'z') for p in ps], 'n')} FROM {end('sh')}),
x_{k} AS (SELECT * FROM p_{k} LEFT JOIN w_{k} USING ({', '.join(ps)}) LEFT JOIN n_{k} USING ({', '.join(ps)}))"""


_BOOKS = [(m, b) for m in MARKETS for b in BOOKMAKERS]


def _core_columns() -> dict[str, str]:
    out = {}
    for m, b in _BOOKS:
        x, mm = f"x_{mangled(m)}_{b}", mangled(m)
        ps = [f"{x}.p{i}" for i in range(len(SEL[m]))]
        out[f"ovr_{mm}_{b}"] = f"{' + '.join(ps)} - 1"
        for i, s in enumerate(SEL[m]):
            out[f"imp_{mm}_{s}_{b}_raw"] = ps[i]
            out |= {f"devig_{mm}_{s}_{b}_proportional": f"{ps[i]} / {_sum(ps)}", f"devig_{mm}_{s}_{b}_power": f"{x}.w{i}", f"devig_{mm}_{s}_{b}_shin": f"{x}.n{i}"}
    for m in MARKETS:
        a, b = (f"x_{mangled(m)}_{b}" for b in BOOKMAKERS)
        out |= {f"div_{mangled(m)}_{s}_shin": f"{a}.n{i} - {b}.n{i}" for i, s in enumerate(SEL[m])}
    return out


_CORE = f"""WITH RECURSIVE {LG.FRAME_CTE}, {', '.join(_fair_ctes(m, b) for m, b in _BOOKS)},
core AS (SELECT f.match_id, {', '.join(f'{e} AS {n}' for n, e in _core_columns().items())} FROM f {' '.join(f'JOIN x_{mangled(m)}_{b} ON x_{mangled(m)}_{b}.match_id = f.match_id' for m, b in _BOOKS)})"""
_CORE_ROUNDED = f"{_CORE} SELECT match_id, {', '.join(o6(n, n) for n in _core_columns())} FROM core"


@query(_CORE_ROUNDED)
def odds_core_features(spark, sf_dir):
    return rounded(X.odds_core(LG.flat(spark, sf_dir)))


_SIDES = "(SELECT unnest(['home', 'away']) AS side), (SELECT unnest([5, 10]) AS n), (SELECT unnest(['pts', 'gf', 'ga', 'gd', 'n']) AS stat)"
_PICKS = "(SELECT unnest(['1x2', '1x2', '1x2', 'ou_2_5', 'ou_2_5']) AS m, unnest(['home', 'draw', 'away', 'over', 'under']) AS s)"


@query(f"""WITH b AS (SELECT unnest(['bet365', 'market_avg']) AS b), c AS (
  SELECT concat('imp_', m, '_', s, '_', b, '_raw') AS c FROM {_PICKS}, b UNION ALL SELECT DISTINCT concat('ovr_', m, '_', b) FROM {_PICKS}, b
  UNION ALL SELECT concat('devig_', m, '_', s, '_', b, '_', x) FROM {_PICKS}, b, (SELECT unnest(['proportional', 'power', 'shin']) AS x)),
d AS (SELECT concat('div_', m, '_', s, '_shin') AS c FROM {_PICKS})
SELECT 'odds_core' AS feature_group, c AS feature FROM (SELECT c FROM c UNION ALL SELECT c FROM d) UNION ALL SELECT 'odds_consensus', c FROM c UNION ALL SELECT 'odds_divergence', c FROM d
UNION ALL SELECT 'team_form', concat(side, '_form_', stat, '_last', n) FROM {_SIDES}""")
def feature_allowlist(spark, sf_dir):
    """The columns that a model may use, by group."""
    return spark.createDataFrame([(g, c) for g, names in X.known_columns().items() for c in names], "feature_group string, feature string")


def _with_proportional(spark, sf_dir):
    """The labelled frame with proportional fair prices only: what the baseline needs, JVM-side."""
    f = LG.labelled(spark, sf_dir)
    for m in MARKETS:
        for b in ("bet365", "market_avg"):
            fair = O.devig("proportional", _raw(b, m))
            f = f.withColumn("_f", fair).withColumns({f"devig_{mangled(m)}_{s}_{b}_proportional": F.get("_f", F.lit(i)) for i, s in enumerate(SEL[m])}).drop("_f")
    return f


def _split(frame):
    return S.FractionSplit(0.7).assign(frame)


def _fair_sql(s: str, book: str) -> str:
    c = [f"odds_1x2_{x}_{book}" for x in SEL["1x2"]]
    return f"(1 / odds_1x2_{s}_{book}) / (" + " + ".join(f"1 / {x}" for x in c) + ")"


SCORED_SQL = f"""{CTE}, sp AS (
  SELECT f.*, CASE WHEN row_number() OVER (PARTITION BY league_key ORDER BY match_date, match_id) <= ceil(count(*) OVER (PARTITION BY league_key) * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split,
    CASE WHEN ft_home > ft_away THEN 'home' WHEN ft_home = ft_away THEN 'draw' ELSE 'away' END AS outcome FROM f),
sc AS (
  SELECT match_id, league_key, match_date, split, outcome, {', '.join(f'coalesce({_fair_sql(s, "bet365")}, {_fair_sql(s, "market_avg")}) AS p_{s}' for s in SEL['1x2'])},
    {', '.join(f'coalesce(odds_1x2_{s}_bet365, odds_1x2_{s}_market_avg) AS o_{s}' for s in SEL['1x2'])} FROM sp),
te AS (SELECT * FROM sc WHERE split = 'test' AND p_home IS NOT NULL),
lo AS (
  SELECT match_id, 'home' AS selection, p_home AS p, o_home AS o, outcome = 'home' AS won FROM te UNION ALL
  SELECT match_id, 'draw', p_draw, o_draw, outcome = 'draw' FROM te UNION ALL SELECT match_id, 'away', p_away, o_away, outcome = 'away' FROM te)"""


def _test_rows(spark, sf_dir):
    return B.scored(B.MarketBaseline(), _split(_with_proportional(spark, sf_dir)), "1x2")


@query(f"{SCORED_SQL} SELECT match_id, {', '.join(o6(f'p_{s}', f'p_{s}') for s in SEL['1x2'])} FROM sc")
def baseline_predictions(spark, sf_dir):
    out = B.MarketBaseline().predict(_split(_with_proportional(spark, sf_dir)), "1x2")
    return rounded(out.select("match_id", *[f"p_{s}" for s in SEL["1x2"]]))


@query(f"{SCORED_SQL} SELECT league_key, CAST(count(*) AS BIGINT) AS n, {o6('avg(-ln(least(greatest(CASE outcome WHEN $$home$$ THEN p_home WHEN $$draw$$ THEN p_draw ELSE p_away END, 1e-12), 1)))', 'log_loss')}, {o6('avg(pow(p_home - (outcome = $$home$$)::INT, 2) + pow(p_draw - (outcome = $$draw$$)::INT, 2) + pow(p_away - (outcome = $$away$$)::INT, 2))', 'brier')} FROM te GROUP BY 1")
def log_loss_brier(spark, sf_dir):
    return _test_rows(spark, sf_dir).groupBy("league_key").agg(F.count("*").alias("n"), r6(M.log_loss(SEL["1x2"])).alias("log_loss"), r6(M.brier(SEL["1x2"])).alias("brier"))


_BIN = " + ".join(f"(p >= CAST('{e!r}' AS DOUBLE))::INT" for e in M.EDGES[1:])


@query(f"{SCORED_SQL}, b AS (SELECT {_BIN} AS bin, p, won FROM lo) SELECT CAST(range AS INTEGER) AS bin, CAST(count(p) AS BIGINT) AS n, {o6('avg(p)', 'mean_p')}, {o6('avg(won::INT::DOUBLE)', 'hit_rate')} FROM range(10) LEFT JOIN b ON b.bin = range GROUP BY range")
def calibration_table(spark, sf_dir):
    return rounded(M.calibration(_test_rows(spark, sf_dir), SEL["1x2"]))


@query(f"{SCORED_SQL}, b AS (SELECT {_BIN} AS bin, p, won FROM lo), c AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(won::INT::DOUBLE) AS h FROM b GROUP BY 1) SELECT round(sum(n * abs(p - h)) / sum(n), 6) AS ece FROM c")
def calibration_error(spark, sf_dir):
    return M.calibration_error(M.calibration(_test_rows(spark, sf_dir), SEL["1x2"]))


def _sim_sql(mode: str, threshold: str, test: str) -> str:
    return f"""{SCORED_SQL}, s AS (SELECT count(*) AS n, sum(CASE WHEN won THEN o - 1 ELSE -1 END) AS g, count_if(won) AS h FROM lo WHERE {test})
SELECT '{mode}' AS mode, {threshold} AS threshold, CAST(n AS BIGINT) AS n_bets, CAST(n AS DOUBLE) AS staked, round(coalesce(g, 0), 4) + 0.0 AS profit, CASE WHEN n > 0 THEN round(round(g, 4) / n, 6) + 0.0 END AS roi, CASE WHEN n > 0 THEN round(h / n::DOUBLE, 6) END AS hit_rate FROM s"""


@query(_sim_sql("value_threshold", "CAST(0.02 AS DOUBLE)", "p * o > 1.02::DOUBLE"))
def simulate_value(spark, sf_dir):
    return rounded(M.simulate(_test_rows(spark, sf_dir), SEL["1x2"]))


@query(_sim_sql("bet_all", "CASE WHEN n = 0 THEN CAST(0.02 AS DOUBLE) END", "o IS NOT NULL"))
def simulate_all(spark, sf_dir):
    return rounded(M.simulate(_test_rows(spark, sf_dir), SEL["1x2"], "bet_all"))


def _report_sql(method: str) -> str:
    p = lambda s: f"coalesce(devig_1x2_{s}_bet365_{method}, devig_1x2_{s}_market_avg_{method})"
    return f"""SELECT 'market_{method}' AS predictor, '1x2' AS market, CAST(count(*) AS BIGINT) AS n,
  round(avg(-ln(least(greatest(CASE outcome WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END, 1e-12), 1))), 5) AS log_loss, round(avg(pow(p_home - (outcome = 'home')::INT, 2) + pow(p_draw - (outcome = 'draw')::INT, 2) + pow(p_away - (outcome = 'away')::INT, 2)), 5) AS brier,
  CAST(sum(vn) AS BIGINT) AS value_bets, CASE WHEN sum(vn) > 0 THEN round(round(sum(vg), 4) / sum(vn), 6) END AS value_roi, CAST(sum(an) AS BIGINT) AS all_bets, round(round(sum(ag), 4) / sum(an), 6) AS all_roi
FROM (SELECT *, {_sum(f'coalesce((p_{s} * o_{s} > 1.02::DOUBLE)::INT, 0)' for s in SEL['1x2'])} AS vn, {_sum(f"CASE WHEN p_{s} * o_{s} > 1.02::DOUBLE THEN CASE WHEN outcome = '{s}' THEN o_{s} - 1 ELSE -1 END ELSE 0 END" for s in SEL['1x2'])} AS vg,
  {_sum(f'(o_{s} IS NOT NULL)::INT' for s in SEL['1x2'])} AS an, {_sum(f"CASE WHEN o_{s} IS NULL THEN 0 WHEN outcome = '{s}' THEN o_{s} - 1 ELSE -1 END" for s in SEL['1x2'])} AS ag
  FROM (SELECT outcome, {', '.join(f'coalesce(odds_1x2_{s}_bet365, odds_1x2_{s}_market_avg) AS o_{s}, {p(s)} AS p_{s}' for s in SEL['1x2'])} FROM sp JOIN core USING (match_id) WHERE split = 'test') WHERE p_home IS NOT NULL)"""


@query(_CORE + ", " + SCORED_SQL[SCORED_SQL.index("sp AS (") : SCORED_SQL.index("sc AS (")].rstrip().rstrip(",") + " " + " UNION ALL ".join(_report_sql(m) for m in ("power", "proportional", "shin")))
def backtest_report(spark, sf_dir):
    frame = D.with_labels(LG.flat(spark, sf_dir))
    shared_folder(spark)
    # pivot, split and features once for all reports
    frame = _split(X.with_features(frame, ["odds_core"])).filter("split = 'test'").checkpoint()
    return B.comparison([B.report(B.MarketBaseline(m), frame, "1x2") for m in O.devig_methods()])


# --- form, splits ------------------------------------------------------------------------------------

APPEAR_SQL = f"""{CTE}, a AS (
  SELECT match_id, match_date, 'home' AS side, home_team_id AS team_id, ft_home AS gf, ft_away AS ga FROM m UNION ALL
  SELECT match_id, match_date, 'away', away_team_id, ft_away, ft_home FROM m),
ap AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM a)"""


@query(f"{APPEAR_SQL} SELECT match_id, side, team_id, CAST(gf AS BIGINT) AS gf, CAST(ga AS BIGINT) AS ga, pts FROM ap")
def appearances(spark, sf_dir):
    return X.appearances(LG.matches(spark, sf_dir)).select("match_id", "side", "team_id", "gf", "ga", "pts")


_FORM_COLS = [f"{side}_form_{stat}_last{n}" for side in ("home", "away") for n in (5, 10) for stat in X.STATS]


def _form_sql() -> str:
    w = "OVER (PARTITION BY team_id ORDER BY match_date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    cols = []
    for n in (5, 10):
        o = w.replace("{n}", str(n))
        cols += [f"avg({c}) {o} AS {c}_last{n}" for c in ("pts", "gf", "ga")] + [f"avg(gf) {o} - avg(ga) {o} AS gd_last{n}", f"count(*) {o} AS n_last{n}"]
    out = []
    for side in ("home", "away"):
        for n in (5, 10):
            for stat in X.STATS:
                e = f"max(CASE WHEN side = '{side}' THEN {stat}_last{n} END)"
                out.append(f"CAST({e} AS BIGINT) AS {side}_form_n_last{n}" if stat == "n" else o6(e, f"{side}_form_{stat}_last{n}"))
    return f"{APPEAR_SQL}, r AS (SELECT match_id, side, {', '.join(cols)} FROM ap) SELECT match_id, {', '.join(out)} FROM r GROUP BY match_id"


@query(_form_sql())
def team_form(spark, sf_dir):
    return rounded(X.team_form(LG.matches(spark, sf_dir)))


@query(f"{CTE} SELECT match_id, CASE WHEN match_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM m")
def cutoff_split(spark, sf_dir):
    return S.CutoffSplit(datetime.date(1999, 1, 1)).assign(LG.matches(spark, sf_dir)).select("match_id", "split")


@query(f"{SCORED_SQL} SELECT match_id, split FROM sp")
def fraction_split(spark, sf_dir):
    return _split(LG.matches(spark, sf_dir)).select("match_id", "split")


_BLOCKS = f"{CTE}, b AS (SELECT match_id, CAST(floor((row_number() OVER (ORDER BY match_date, match_id) - 1) / ceil(count(*) OVER () / 5.0)) AS INTEGER) AS block FROM m)"


@query(f"{_BLOCKS} SELECT match_id, CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold THEN 'test' ELSE 'train' END AS split FROM b, range(1, 5) AS r(fold) WHERE block <= fold AND fold <= (SELECT max(block) FROM b)")
def walk_forward_expanding(spark, sf_dir):
    return S.WalkForward(4).folds(LG.matches(spark, sf_dir)).select("match_id", "fold", "split")


@query(f"{_BLOCKS} SELECT match_id, CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold THEN 'test' ELSE 'train' END AS split FROM b, range(1, 5) AS r(fold) WHERE (block = fold OR block = fold - 1) AND fold <= (SELECT max(block) FROM b)")
def walk_forward_rolling(spark, sf_dir):
    return S.WalkForward(4, expanding=False).folds(LG.matches(spark, sf_dir)).select("match_id", "fold", "split")


@query("""WITH s AS (SELECT o_orderpriority AS scope, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM orders)
SELECT scope, max(CASE WHEN split = 'train' THEN d END) AS last_train, min(CASE WHEN split = 'test' THEN d END) AS first_test FROM s GROUP BY scope HAVING max(CASE WHEN split = 'train' THEN d END) > min(CASE WHEN split = 'test' THEN d END)""")
def leakage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderdate").cast("date").alias("match_date"), F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"))
    return S.leaks(o, "scope")


@query(f"{CTE} SELECT match_id, {o6('exp(-0.001::DOUBLE * date_diff($$day$$, match_date, (SELECT max(match_date) FROM m)))', 'weight')} FROM m")
def decay_weights(spark, sf_dir):
    m = LG.matches(spark, sf_dir)
    last = m.agg(F.max("match_date")).scalar()
    return m.select("match_id", r6(S.decay_weight(F.col("match_date"), last, 0.001)).alias("weight"))


# --- goal models -------------------------------------------------------------------------------------

_RATES = "SELECT match_id, CAST(0.8 AS DOUBLE) + wa / CAST(5.0 AS DOUBLE) AS lam, CAST(0.6 AS DOUBLE) + wb / CAST(5.0 AS DOUBLE) AS mu, CAST(-0.05 AS DOUBLE) AS rho FROM m"
_GRID = f"""{CTE}, r AS ({_RATES}), d AS (SELECT DISTINCT lam, mu, rho FROM r), g AS (
  SELECT lam, mu, rho, x, y, greatest(exp(x * ln(lam) - lam - ln(factorial(x::INT)::DOUBLE) + y * ln(mu) - mu - ln(factorial(y::INT)::DOUBLE)) * CASE WHEN x = 0 AND y = 0 THEN 1 - lam * mu * rho WHEN x = 1 AND y = 0 THEN 1 + mu * rho WHEN x = 0 AND y = 1 THEN 1 + lam * rho WHEN x = 1 AND y = 1 THEN 1 - rho ELSE 1 END, 0) AS w
  FROM d, range(11) AS a(x), range(11) AS b(y))"""


def _rates(spark, sf_dir):
    return LG.matches(spark, sf_dir).selectExpr("match_id", "CAST(0.8 AS DOUBLE) + wa / CAST(5.0 AS DOUBLE) AS lam", "CAST(0.6 AS DOUBLE) + wb / CAST(5.0 AS DOUBLE) AS mu", "CAST(-0.05 AS DOUBLE) AS rho")


@query(f"{_GRID} SELECT {o6('lam', 'lam')}, {o6('mu', 'mu')}, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {o6('w', 'w')} FROM g")
def score_grid(spark, sf_dir):
    rates = _rates(spark, sf_dir).select("lam", "mu", "rho").distinct()
    return rounded(G.score_grid(rates).select("lam", "mu", "x", "y", "w"))


@query(f"{_GRID}, s AS (SELECT lam, mu, sum(w) AS t, sum(CASE WHEN x > y THEN w ELSE 0 END) AS h, sum(CASE WHEN x = y THEN w ELSE 0 END) AS d, sum(CASE WHEN x < y THEN w ELSE 0 END) AS a, sum(CASE WHEN x + y > 2 THEN w ELSE 0 END) AS o FROM g GROUP BY 1, 2) SELECT match_id, {o6('h / t', 'p_home')}, {o6('d / t', 'p_draw')}, {o6('a / t', 'p_away')}, {o6('o / t', 'p_over')} FROM r JOIN s USING (lam, mu)")
def grid_probabilities(spark, sf_dir):
    g = _rates(spark, sf_dir).withColumn("_g", G.collapsed(F.col("lam"), F.col("mu"), F.col("rho")))
    return rounded(g.select("match_id", F.col("_g.home").alias("p_home"), F.col("_g.draw").alias("p_draw"), F.col("_g.away").alias("p_away"), F.col("_g.over").alias("p_over")))


@query()
def goal_model_fit(spark, sf_dir):
    return rounded(GM.fit(LG.matches(spark, sf_dir), 0.001))


@query()
def goal_model_predictions(spark, sf_dir):
    frame = _split(LG.matches(spark, sf_dir))
    out = GM.GoalPredictor(GM.fit(frame.filter("split = 'train'"))).predict(frame, "1x2")
    return rounded(out.select("match_id", "p_home", "p_draw", "p_away"))


@query()
def coherence_feature(spark, sf_dir):
    f = _split(LG.labelled(spark, sf_dir))
    for m, names in (("1x2", ("home", "draw")), ("ou_2.5", ("over",))):
        f = f.withColumn("_f", O.devig("shin", _raw("bet365", m))).withColumns({f"devig_{mangled(m)}_{s}_bet365_shin": F.get("_f", F.lit(SEL[m].index(s))) for s in names}).drop("_f")
    return rounded(GM.coherence(f))


@query(f"""{SCORED_SQL}, x AS (SELECT sp.match_id, sp.league_key, home_team_id, away_team_id, sp.split, CASE WHEN sp.split = 'train' THEN (ft_home = ft_away)::INT - CAST(0.27 AS DOUBLE) END AS residual FROM sp),
t AS (SELECT league_key, team_id, sum(residual) AS total, count(residual) AS n FROM (SELECT league_key, home_team_id AS team_id, residual FROM x WHERE split = 'train' UNION ALL SELECT league_key, away_team_id, residual FROM x WHERE split = 'train') GROUP BY 1, 2)
SELECT match_id, {o6("CASE WHEN split = 'train' THEN CASE WHEN h.n > 1 THEN (h.total - residual) / (h.n - 1) END ELSE h.total / h.n END", "home_draw_residual")}, {o6("CASE WHEN split = 'train' THEN CASE WHEN a.n > 1 THEN (a.total - residual) / (a.n - 1) END ELSE a.total / a.n END", "away_draw_residual")}
FROM x LEFT JOIN t h ON h.league_key = x.league_key AND h.team_id = home_team_id LEFT JOIN t a ON a.league_key = x.league_key AND a.team_id = away_team_id""")
def draw_residual_means(spark, sf_dir):
    """Team means of a given residual (drawn minus 0.27): leave-one-out on training rows."""
    f = _split(LG.matches(spark, sf_dir))
    drawn = F.when(F.col("ft_home") == F.col("ft_away"), 1).otherwise(0)
    return rounded(GM.residual_means(f.withColumn("residual", F.when(F.col("split") == "train", drawn - F.lit(0.27)))))


@query()
def draw_residual_feature(spark, sf_dir):
    return rounded(GM.draw_residuals(_split(LG.matches(spark, sf_dir))))


# --- evidence, blend, log ----------------------------------------------------------------------------

_DEMO = (E.Finding("demo", "provisionally_promoted", "1x2"), E.Finding("idle", "rejected", "1x2"))


def _blend_input(spark, sf_dir):
    f = LG.matches(spark, sf_dir).select("match_id", "wa", "wb", "wc")
    t = F.col("wa") + F.col("wb") + F.col("wc")
    f = f.withColumns({f"base_{s}": F.when(F.col("match_id") % 11 != 0, F.col(w).cast("double") / t) for s, w in zip(SEL["1x2"], ("wa", "wb", "wc"))})
    t2 = F.col("wa") + F.col("wb") + F.col("wc") + 3
    return f.withColumns({f"demo_{s}": F.when(F.col("match_id") % 5 != 0, (F.col(w) + 1).cast("double") / t2) for s, w in zip(SEL["1x2"], ("wa", "wb", "wc"))})


_BLEND = f"""{CTE}, b AS (SELECT match_id, {', '.join(f'CASE WHEN match_id % 11 <> 0 THEN CAST({w} AS DOUBLE) / (wa + wb + wc) END AS b_{s}, CASE WHEN match_id % 5 <> 0 THEN CAST({w} + 1 AS DOUBLE) / (wa + wb + wc + 3) END AS d_{s}' for s, w in zip(SEL['1x2'], ('wa', 'wb', 'wc')))} FROM m),
e AS (SELECT *, {', '.join(f'exp(ln(b_{s}) + 0.25 * coalesce(ln(d_{s}) - ln(b_{s}), 0)) AS e_{s}' for s in SEL['1x2'])} FROM b)"""


@query(f"{_BLEND} SELECT match_id, {', '.join(o6(f'e_{s} / (e_home + e_draw + e_away)', f'p_{s}') for s in SEL['1x2'])} FROM e")
def canonical_blend(spark, sf_dir):
    return rounded(E.blend(_blend_input(spark, sf_dir), "1x2", _DEMO).select("match_id", *[f"p_{s}" for s in SEL["1x2"]]))


_POOL = {s: (f"coalesce(devig_1x2_{s}_bet365_proportional, devig_1x2_{s}_market_avg_proportional)", f"coalesce(devig_1x2_{s}_bet365_power, devig_1x2_{s}_market_avg_power)") for s in SEL["1x2"]}


@query(f"{_CORE}, e AS (SELECT match_id, {', '.join(f'exp(0.75::DOUBLE * ln({b}) + 0.25::DOUBLE * ln({f})) AS e_{s}' for s, (b, f) in _POOL.items())} FROM core) SELECT match_id, {', '.join(o6(f'e_{s} / (e_home + e_draw + e_away)', f'p_{s}') for s in SEL['1x2'])} FROM e")
def canonical_predictions(spark, sf_dir):
    """The blended predictor fitted and applied: proportional prices as the baseline, power prices as a provisional finding."""
    frame = X.with_features(LG.flat(spark, sf_dir), ["odds_core"])
    model = E.Canonical(B.MarketBaseline(), _DEMO, lambda _, finding: B.MarketBaseline("power")).fit(frame, "1x2")
    return rounded(model.predict(frame, "1x2").select("match_id", *[f"p_{s}" for s in SEL["1x2"]]))


@query(f"""{_BLEND}, l AS (
  {' UNION ALL '.join(f"SELECT match_id, 'value' AS kind, '{role}' AS role, NULL AS finding_id, '{s}' AS selection, {e} AS value FROM e" for role, ex in (('baseline', 'b_{s}'), ('canonical', 'e_{s} / (e_home + e_draw + e_away)'), ('promoted_only', 'b_{s} / (b_home + b_draw + b_away)')) for s in SEL['1x2'] for e in [ex.replace('{s}', s)])}
  UNION ALL {' UNION ALL '.join(f"SELECT match_id, 'contribution', NULL, 'demo', '{s}', ln(d_{s}) - ln(b_{s}) FROM e" for s in SEL['1x2'])})
SELECT match_id, kind, role, finding_id, selection, {o6('value', 'value')} FROM l""")
def predictions_log(spark, sf_dir):
    log = E.predictions_log(E.explain(_blend_input(spark, sf_dir), "1x2", _DEMO), "1x2", _DEMO)
    return rounded(log.select("match_id", "kind", "role", "finding_id", "selection", "value"))


def _saved_log(spark, sf_dir):
    log = E.ordered_predictions(E.explain(_blend_input(spark, sf_dir), "1x2", _DEMO), "1x2", _DEMO, {"demo": "abc"})
    return E.save_predictions(log, _DEMO, f"{shared_folder(spark).rstrip('/')}/kickmill-predictions", order=lambda log: log)


@query(ORACLES["predictions_log"].replace("kind, role, finding_id, selection,", "kind, role, finding_id, CASE WHEN kind = 'contribution' THEN 'provisionally_promoted' END AS tier, CASE WHEN kind = 'contribution' THEN 0.25::DOUBLE END AS weight, CASE WHEN kind = 'contribution' THEN 'abc' END AS model_hash, selection,"))
def saved_predictions(spark, sf_dir):
    """The log written, and read back by its manifest."""
    back = E.load_predictions(spark, _saved_log(spark, sf_dir)["path"])
    return rounded(back.select("match_id", "kind", "role", "finding_id", "tier", "weight", "model_hash", "selection", "value"))


@query("SELECT 'prediction' AS kind, 'backtest' AS mode, CAST(count(*) * 12 AS BIGINT) AS rows_total, 'demo' AS finding_id, 'abc' AS model_hash, 0.25::DOUBLE AS weight, CAST(2 AS BIGINT) AS n_findings, true AS same_hash FROM orders")
def predictions_manifest(spark, sf_dir):
    """What the manifest keeps; the content hash of what is read back is the manifest's."""
    m = _saved_log(spark, sf_dir)
    again = D.content_hash(E.load_predictions(spark, m["path"]))
    (finding, model_hash), = m["extra"]["model_hashes"].items()
    row = (m["kind"], m["extra"]["mode"], m["rows"]["rows_total"], finding, model_hash, m["extra"]["tier_weights"]["provisionally_promoted"], len(m["extra"]["findings_registry_snapshot"]), again == m["content_hash"])
    return spark.createDataFrame([row], "kind string, mode string, rows_total long, finding_id string, model_hash string, weight double, n_findings long, same_hash boolean")


@query("SELECT * FROM (VALUES ('a', 'promoted', 1.0::DOUBLE, true), ('b', 'provisionally_promoted', 0.25::DOUBLE, true), ('c', 'not_confirmed', 0.0::DOUBLE, false), ('d', 'rejected', 0.0::DOUBLE, false)) AS t(finding_id, tier, weight, is_live)")
def tier_weights(spark, sf_dir):
    found = [E.Finding(i, t, "1x2") for i, t in zip("abcd", ("promoted", "provisionally_promoted", "not_confirmed", "rejected"))]
    return E.registry_rows(spark, found).select("finding_id", "tier", "weight", "is_live")


@query()
def tabular_predictions(spark, sf_dir):
    frame = _split(X.with_features(LG.labelled(spark, sf_dir), ["team_form"]))
    model = T.TabularPredictor(["team_form"]).fit(frame, ["1x2"])
    return rounded(model.predict(frame.filter("split = 'test'"), "1x2").select("match_id", "p_home", "p_draw", "p_away"))


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation FROM lineitem" for c in _NUMERIC))
def preprocessing_stats(spark, sf_dir):
    """Exact medians, means and deviations of all numeric columns of a table."""
    stats = T.preprocess_stats(table(spark, sf_dir, "lineitem"), _NUMERIC)
    return rounded(spark.createDataFrame([(c, *x) for c, x in stats.items()], "name string, median double, mean double, deviation double"))


@query("SELECT DISTINCT substr(o_orderpriority, 1, 1) AS league_key FROM orders")
def known_leagues(spark, sf_dir):
    return T.known_leagues(LG.matches(spark, sf_dir))


# --- datasets ----------------------------------------------------------------------------------------


@query(f"{SCORED_SQL}, t AS (SELECT CAST(count(*) AS BIGINT) AS rows_total, CAST(count_if(split = 'train') AS BIGINT) AS rows_train, CAST(count_if(split = 'test') AS BIGINT) AS rows_test, CAST(count_if(ht_home IS NOT NULL AND ht_away IS NOT NULL) AS BIGINT) AS rows_with_ht FROM sp) SELECT t.*, league_key, CAST(n AS BIGINT) AS n FROM t, (SELECT league_key, count(*) AS n FROM sp GROUP BY 1)")
def manifest_stats(spark, sf_dir):
    stats = D.manifest_stats(_split(LG.matches(spark, sf_dir)))
    return stats.select("rows_total", "rows_train", "rows_test", "rows_with_ht", F.explode("per_league").alias("league_key", "n"))


_IDENTITY = ["match_id", "league_key", "league_name", "match_date", "home_team_id", "away_team_id", "ft_home", "ft_away", "ht_home", "ht_away", "wa", "wb", "wc"]
_DATASET = f"""SELECT {', '.join(f'b.{c}' for c in _IDENTITY)}, (b.ht_home IS NOT NULL AND b.ht_away IS NOT NULL) AS has_ht, {', '.join(o6(f'b.{c}', c) for c in odds_columns())},
  l.target_1x2, l.target_ou_2_5, l.target_btts, l.target_htft, c.* EXCLUDE (match_id), t.* EXCLUDE (match_id), b.split
FROM ({SCORED_SQL} SELECT sp.* FROM sp) b JOIN ({ORACLES['match_labels']}) l ON l.match_id = b.match_id LEFT JOIN ({_CORE_ROUNDED}) c ON c.match_id = b.match_id LEFT JOIN ({_form_sql()}) t ON t.match_id = b.match_id"""


def _frame(spark, sf_dir):
    return LG.flat(spark, sf_dir).withColumn("kickoff_utc", F.lit(None).cast("timestamp_ntz"))


@query(_DATASET)
def dataset(spark, sf_dir):
    return rounded(D.build(_frame(spark, sf_dir)).drop("kickoff_time", "kickoff_utc"))


@query(f"SELECT match_id, split, target_1x2, home_form_pts_last5, rows_total, rows_train, 'group_fraction' AS strategy, 'team_form' AS group_name, CAST(20 AS BIGINT) AS group_columns FROM ({_DATASET}), (SELECT CAST(count(*) AS BIGINT) AS rows_total, CAST(count_if(split = 'train') AS BIGINT) AS rows_train FROM ({SCORED_SQL} SELECT split FROM sp))")
def saved_dataset(spark, sf_dir):
    """A dataset of one group written in order, read back by its manifest, with what the manifest tells."""
    m = D.save_dataset(_frame(spark, sf_dir), f"{shared_folder(spark).rstrip('/')}/kickmill-datasets", ["team_form"])
    told = D.load_manifest(spark, m["path"])
    group, = told.extra["feature_groups"]
    out = D.load(spark, m["path"]).select("match_id", "split", "target_1x2", "home_form_pts_last5")
    kept = {"rows_total": told.rows["rows_total"], "rows_train": told.rows["rows_train"], "strategy": told.extra["split"]["strategy"], "group_name": group["name"], "group_columns": len(group["columns"])}
    return rounded(out.withColumns({k: F.lit(v).cast("long" if isinstance(v, int) else "string") for k, v in kept.items()}))


@query("SELECT c_custkey, sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR))) AS h FROM customer")
def row_hashes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    return c.select("c_custkey", D.row_hash(c).alias("h"))


# --- the same operators on the tables as they are ----------------------------------------------------


@query("SELECT l_orderkey, round(min(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(min(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(min(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1")
def lineitem_pivot(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.min("l_quantity")))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def lineitem_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS measure, unnest([l_quantity + 0.0, l_discount + 0.0, l_tax + 0.0]) AS value FROM lineitem")
def lineitem_unpivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr("l_orderkey", "l_linenumber", "stack(3, 'quantity', l_quantity + 0.0D, 'discount', l_discount + 0.0D, 'tax', l_tax + 0.0D) AS (measure, value)")


@query("""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity AS q FROM lineitem), n AS (SELECT k, count(*) AS n, min(q) AS least, max(q) AS most FROM l GROUP BY k)
SELECT CASE WHEN k % 3 <> 0 THEN 'imported' WHEN k % 2 = 0 THEN 'duplicate' ELSE 'conflict' END AS status, CAST(sum(1) AS BIGINT) AS n FROM n GROUP BY 1""")
def classified_odds(spark, sf_dir):
    """Line items as rows of a file beside stored ones: a third is stored, every other of these with another score."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy(k.alias("row_index")).agg(F.min("l_quantity").cast("int").alias("ft_home"))
    key = F.concat_ws("|", F.lit("L"), F.col("row_index"), F.lit(0), F.lit("2024-01-01"))
    rows = rows.select("row_index", key.alias("pairing"), (F.col("row_index") + 1).alias("new_id"), F.lit(None).cast("timestamp_ntz").alias("kickoff_utc"), key.alias("dedupe_key"), F.lit(None).cast("string").alias("external_id"), "ft_home", F.lit(0).alias("ft_away"))
    stored = rows.filter("row_index % 3 = 0").select(F.col("row_index").alias("id"), "pairing", F.lit(False).alias("timed"), "dedupe_key", (F.col("ft_home") + (F.col("row_index") % 2).cast("int")).alias("ft_home"), "ft_away")
    held = spark.createDataFrame([], "external_id string, match_id long")
    return RC.decide(rows, stored, held).groupBy(F.col("outcome").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean10, CAST(count(value) OVER w AS BIGINT) AS n10 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def events_rolling(spark, sf_dir):
    """Means of the ten events before, by type: few keys of very many rows, which no task holds whole."""
    columns = lambda w: {"mean10": F.avg("value").over(w.rowsBetween(-10, -1)), "n10": F.count("value").over(w.rowsBetween(-10, -1))}
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return rounded(RW.rolled(e, "event_type", ["ts", "event_id"], 10, columns).select("event_id", "mean10", "n10"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER w, 6) AS mean5, CAST(count(*) OVER w AS BIGINT) AS n5 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def orders_rolling(spark, sf_dir):
    """Form of customers: the mean price of the five orders before, by the operator for teams."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team_id"), F.col("o_orderdate").alias("match_date"), F.col("o_orderkey").alias("match_id"), *[F.col("o_totalprice").alias(c) for c in ("pts", "gf", "ga")])
    return X.rolling_form(o).select(F.col("match_id").alias("o_orderkey"), F.round("pts_last5", 6).alias("mean5"), F.col("n_last5").alias("n5"))


@query(f"WITH e AS (SELECT event_id, event_type, (value - floor(value)) AS p FROM events) SELECT event_type, CAST({_BIN} AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM e WHERE p IS NOT NULL GROUP BY ALL")
def events_binned(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") - F.floor("value")).alias("p")).filter("p IS NOT NULL")
    return e.select("event_type", M.bin_of(F.col("p")).alias("bin")).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def streamed_counts(spark, sf_dir):
    """Events read as a stream and counted by hour and type; all windows, closed or not."""
    schema = table(spark, sf_dir, "events").schema
    name = f"kickmill_{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    counts = SI.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName(name)
    counts.option("checkpointLocation", f"{shared_folder(spark).rstrip('/')}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("total", 4) + 0.0).alias("total"))


@query("SELECT o_custkey AS name, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS candidate, round(max(o_totalprice), 6) AS similarity FROM orders GROUP BY 1")
def top_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("similarity"))
    return rounded(RC.top_similar(o))


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS n_rows FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_head(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    seen = RD.preview(raw)
    return seen["head"].select("o_orderkey", "o_custkey", "d", F.lit(seen["rows"]).cast("long").alias("n_rows"))
