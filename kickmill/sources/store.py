"""The table store: versioned lists of Parquet parts; one import is one version."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickmill.operators.splits import global_row_number

SCHEMAS = {
    "leagues": "id long, canonical_key string, name string, country string",
    "teams": "id long, canonical_name string, normalized_key string",
    "aliases": "id long, team_id long, alias string, normalized_alias string, source string, confidence double",
    "matches": "id long, league_key string, home_team_id long, away_team_id long, match_date date, kickoff_utc timestamp_ntz, ht_home int, ht_away int, ft_home int, ft_away int, status string, import_id long, dedupe_key string",
    "sources": "id long, match_id long, source string, external_id string",
    "odds": "id long, match_id long, bookmaker string, market string, selection string, decimal_odds double, recorded_at timestamp_ntz, line double, price_point string",
    "imports": "id long, filename string, profile_name string, rows_total long, rows_imported long, rows_duplicate long, rows_enriched long, rows_rejected long, report_json string, created_at timestamp_ntz",
    "notes": "import_id long, row_index long, kind string, message string",
}


DEFAULT_FOLDER = "kickmill-store"


def open_store(spark: SparkSession, url: str | None = None) -> Store:
    """The store at ``url``, else at the environment's ``KICKMILL_STORE``, else in the session's warehouse."""
    return Store(spark, url or os.environ.get("KICKMILL_STORE") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{DEFAULT_FOLDER}")


class Store:
    """Tables as lists of Parquet parts.  A version is one JSON file that names every table's parts.

    ``commit`` writes only what is new, then claims the next version's number and publishes its file by renaming it; a number that another
    writer has claimed meanwhile is an error, and what was written stays invisible.  Readers see the last version, never a part of it.
    A claim whose writer was lost before it published has to be deleted by hand.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def version(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the last version, 0 if there is none, and its parts."""
        fs, root = self._fs(f"{self.folder}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json")) if fs.exists(root) else []
        if not names:
            return 0, {n: [] for n in SCHEMAS}
        text = self.spark.read.text(f"{self.folder}/versions/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1].split(".")[0]), {n: [] for n in SCHEMAS} | json.loads(text)

    def tables(self) -> dict[str, DataFrame]:
        _, parts = self.version()
        return {n: self.spark.read.schema(s).parquet(*[f"{self.folder}/{p}" for p in parts[n]]) if parts[n] else self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}

    def commit(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> int:
        """``added`` rows join their tables, ``replaced`` tables are written anew; all become visible together."""
        number, parts = self.version()
        for name, df in [*added.items(), *(replaced or {}).items()]:
            part = f"{name}/{number + 1:08d}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{part}")
            parts[name] = [*(parts[name] if name in added else []), part]
        self._publish(number + 1, json.dumps(parts))
        return number + 1

    def _publish(self, number: int, text: str) -> None:
        """The version's file appears whole, under a name that only the writer that claimed its number uses."""
        name = f"{self.folder}/versions/{number:08d}"
        fs, claim = self._fs(f"{name}.claim")
        fs.create(claim, False).close()  # an error if another writer has the number
        try:
            _, aside = self._fs(f"{name}.{uuid.uuid4().hex}.tmp")
            out = fs.create(aside, False)
            out.write(text.encode())
            out.close()
            if not fs.rename(aside, self._fs(f"{name}.json")[1]):
                raise OSError(f"{name}.json can't be made")
        except BaseException:
            fs.delete(claim, False)
            raise

    def compact(self) -> int:
        """Every table as one part."""
        return self.commit({}, self.tables())


class Unit:
    """One file's changes: repositories by name, and all of it committed or none."""

    def __init__(self, store: Store):
        self.store = store

    def __enter__(self) -> Unit:
        self.tables, self.added, self.replaced = self.store.tables(), {}, {}
        return self

    def __exit__(self, *_) -> None:
        self.rollback()

    def add(self, name: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Append rows, with surrogate ids in the given order, or with their own."""
        new = numbered(self.tables[name], rows, order) if order else as_table(rows, SCHEMAS[name])
        self.added[name] = self.added[name].unionByName(new) if name in self.added else new
        return new

    def update(self, name: str, changes: DataFrame) -> None:
        """Copy on write, of the whole table."""
        self.replaced[name] = updated(self.replaced.get(name, self.tables[name]), changes)

    def get(self, name: str, keys: DataFrame) -> DataFrame:
        return lookup(self.tables[name], keys)

    def commit(self) -> int:
        both = self.added.keys() & self.replaced.keys()
        replaced = self.replaced | {n: self.replaced[n].unionByName(self.added[n]) for n in both}
        done = self.store.commit({n: df for n, df in self.added.items() if n not in both}, replaced)
        self.rollback()
        return done

    def rollback(self) -> None:
        self.added, self.replaced = {}, {}


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Each row of ``keys`` with the stored row of equal values in its columns, the one of least id, or nulls: a batch of point reads."""
    on = keys.columns
    rest = [c for c in table.columns if c not in on]
    first = table.join(keys.distinct(), on, "left_semi").groupBy(*on).agg(F.min_by(F.struct(*rest), "id").alias("_r"))
    return keys.join(first, on, "left").select(*on, *[F.col(f"_r.{c}").alias(c) for c in rest])


def find_by_pairing_date(matches: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored matches of the pairings and days in ``keys`` (league_key, home_team_id, away_team_id, match_date)."""
    on = ["league_key", "home_team_id", "away_team_id", "match_date"]
    return matches.join(keys.select(*on).distinct(), on, "left_semi")


def as_table(rows: DataFrame, schema) -> DataFrame:
    """Columns of the schema, missing ones null."""
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def numbered(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New rows with ids after the largest stored one, in the given order."""
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    return as_table(global_row_number(new, order).withColumn("id", F.col("_n") + last), stored.schema)


def appended(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The stored rows and the numbered new ones."""
    return stored.unionByName(numbered(stored, new, order))


def updated(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Copy on write: non-null values of ``changes`` replace the stored ones."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    out = stored.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in stored.columns])


def import_history(imports: DataFrame) -> DataFrame:
    """Newest first."""
    return imports.orderBy(F.desc("id"))


def count_by_league(matches: DataFrame) -> DataFrame:
    return matches.groupBy("league_key").agg(F.count("*").alias("n"))


def database_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, name, n): stored matches and quotes, matches by league, most first, and every import's counters, newest first."""
    total = lambda name, section: tables[name].agg(F.lit(section).alias("section"), F.lit(None).cast("string").alias("name"), F.count("*").alias("n"), F.lit(0).cast("long").alias("place"))
    names = tables["leagues"].select(F.col("canonical_key").alias("league_key"), F.col("name"))
    leagues = count_by_league(tables["matches"]).join(names, "league_key", "left").select(F.lit("league").alias("section"), F.coalesce("name", "league_key").alias("name"), "n", (-F.col("n")).alias("place"))
    counters = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"rows_{c}").alias("n")) for c in ("imported", "duplicate", "enriched", "rejected")]))
    imports = tables["imports"].select("id", "filename", counters.alias("x")).select(F.concat(F.lit("rows_"), F.col("x.c")).alias("section"), F.col("filename").alias("name"), F.col("x.n").alias("n"), (-F.col("id")).alias("place"))
    out = total("matches", "matches").unionByName(total("odds", "odds_quotes")).unionByName(leagues).unionByName(imports)
    return out.orderBy("section", "place", "name").drop("place")


#: Rows of file k are numbered from k times this on: the rules' order is that of files, then of rows.
FILE_ROWS = 1 << 40


def file_of(row_index: str = "row_index") -> Column:
    return F.floor(F.col(row_index) / FILE_ROWS).cast("long")


def import_notes(outcomes: DataFrame, resolutions: DataFrame, first_import: int) -> DataFrame:
    """(import_id, row_index, kind, message): rejections, warnings and names that were not matched exactly (with the file that has them first)."""
    accepted = F.col("outcome").isin("imported", "duplicate", "enriched")
    here, row = (file_of() + first_import).alias("import_id"), (F.col("row_index") % FILE_ROWS).alias("row_index")
    rejected = outcomes.filter(~accepted).select(here, row, F.lit("rejection").alias("kind"), F.col("outcome").alias("message"))
    warned = outcomes.select(here, row, F.lit("warning").alias("kind"), F.explode("warnings").alias("message"))
    told = resolutions.filter("kind <> 'exact'").select((file_of("first_row") + first_import).alias("import_id"), F.lit(None).cast("long").alias("row_index"), F.lit("resolution").alias("kind"), F.to_json(F.struct("raw", "kind", "matched_key", "confidence")).alias("message"))
    return rejected.unionByName(warned).unionByName(told)


def import_file(spark: SparkSession, store: Store, raw: DataFrame, profile, filename: str) -> DataFrame:
    """Validate, resolve, reconcile and commit one file; returns the report (one row)."""
    return import_files(spark, store, [(raw, filename)], profile)


def import_files(spark: SparkSession, store: Store, files: list[tuple[DataFrame, str]], profile) -> DataFrame:
    """Import files of one profile in their order, in one plan and one unit of work; returns the reports, a row per file.

    What is stored equals imports of one file after another: rows act in the order of files, then of rows.  A report's counters are kept
    as JSON with its import, rejections, warnings and resolutions as rows of ``notes``.
    """
    from kickmill.operators import reconcile as R
    from kickmill.operators import validate as V

    rows = None
    for k, (raw, _) in enumerate(files):
        one = V.validate(raw.withColumn("row_index", F.col("row_index") + k * FILE_ROWS), profile)
        rows = one if rows is None else rows.unionByName(one)
    with Unit(store) as unit:
        old = unit.tables
        done = R.import_rows(rows, profile, old)
        outcomes = done["outcomes"].persist()
        try:
            report = R.import_report(outcomes, file_of().alias("file"))
            columns = [c for c in report.columns if c != "file"]
            by_file = {r.file: r for r in report.collect()}  # one row for each file that has rows
            counts = [tuple(by_file[k][c] for c in columns) if k in by_file else (0,) * len(columns) for k in range(len(files))]
            first_import = (old["imports"].agg(F.max("id")).first()[0] or 0) + 1
            last = old["matches"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
            ids = R.new_match_ids(outcomes, last)
            named = outcomes.join(ids.withColumnsRenamed({"provisional": "match_id", "id": "_id"}), "match_id", "left").withColumn("match_id", F.coalesce("_id", "match_id"))
            new = named.filter("new_match").withColumns({"id": F.col("match_id"), "status": F.lit("completed"), "import_id": file_of() + first_import})
            quotes = named.select("row_index", "match_id", F.posexplode("new_odds").alias("pos", "q")).select("row_index", "pos", "match_id", "q.*")
            sources = named.filter("add_source").select("row_index", "match_id", F.lit(profile.source_name).alias("source"), "external_id")
            res = done["resolutions"]
            unit.add("leagues", done["leagues"], ["first_row"])
            unit.add("teams", res.filter("kind = 'created'").select(F.col("team_id").alias("id"), F.col("raw").alias("canonical_name"), F.col("normal").alias("normalized_key")))
            unit.add("aliases", res.filter("kind IN ('created', 'fuzzy')").select("team_id", F.col("raw").alias("alias"), F.col("normal").alias("normalized_alias"), F.lit(profile.source_name).alias("source"), "confidence"), ["team_id", "normalized_alias"])
            unit.add("matches", new)
            if any(dict(zip(columns, c))["rows_enriched"] for c in counts):  # matches of these files or of earlier ones
                enriched = named.filter("outcome = 'enriched'").select(F.col("match_id").alias("id"), "kickoff_utc", "dedupe_key")
                unit.added["matches"] = updated(unit.added["matches"], enriched)
                if enriched.filter(F.col("id") <= last).limit(1).count():
                    unit.update("matches", enriched)
            unit.add("sources", sources, ["row_index"])
            unit.add("odds", quotes, ["row_index", "pos"])
            unit.add("notes", import_notes(outcomes, res, first_import))
            imports = []
            for k, ((_, filename), c) in enumerate(zip(files, counts)):
                own = dict(zip(columns, c))
                told = json.dumps({"filename": filename, "profile_name": profile.name, **own})
                imports.append((first_import + k, filename, profile.name, own["rows_total"], own["rows_imported"], own["rows_duplicate"], own["rows_enriched"], own["rows_rejected"], told))
            unit.add("imports", spark.createDataFrame(imports, SCHEMAS["imports"].replace(", created_at timestamp_ntz", "")).withColumn("created_at", F.localtimestamp()))
            unit.commit()
            return spark.createDataFrame(counts, report.drop("file").schema)
        finally:
            outcomes.unpersist()
