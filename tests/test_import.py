"""The importer against the scenarios of its rules."""

import pytest

from kickmill.operators.mapping import SEASON_FILES
from kickmill.operators import validate as V
from kickmill.sources.readers import preview, read_table
from kickmill.sources.store import Store, import_file, import_history
from tests.memory import MemoryTables

NARROW = {"Div": "E0", "Date": "17/08/2025", "HomeTeam": "Newcastle", "AwayTeam": "Fulham", "FTHG": "1", "FTAG": "0", "B365H": "1.9", "B365D": "3.4", "B365A": "4.2"}
AH = {"AHh": "-0.5", "B365AHH": "1.95", "B365AHA": "1.87"}


@pytest.fixture
def importer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    count = iter(range(100))

    def run(*rows):
        names = list(dict.fromkeys(k for r in rows for k in r))
        path = tmp_path / f"f{next(count)}.csv"
        path.write_text("\n".join([",".join(names), *[",".join(str(r.get(n, "") or "") for n in names) for r in rows]]))
        return import_file(spark, store, read_table(spark, f"file://{path}"), SEASON_FILES, path.name).first()

    run.store = store
    return run


def test_backfill_repeat_and_conflict(importer):
    assert importer(NARROW).rows_imported == 1
    wide = NARROW | AH | {"B365CH": "1.85", "B365CD": "3.5", "B365CA": "4.4"}
    r = importer(wide)
    assert (r.rows_duplicate, r.odds_quotes_backfilled) == (1, 5)
    assert importer.store.tables()["odds"].count() == 8
    assert importer(wide).odds_quotes_backfilled == 0
    r = importer(NARROW | {"B365H": "2.5"})
    assert (r.rows_duplicate, r.odds_quotes_backfilled, r.n_warnings) == (1, 0, 2)  # the conflict, and a trio below 1
    assert importer.store.tables()["odds"].filter("selection = 'home' AND price_point IS NULL").first().decimal_odds == 1.9
    assert [x.id for x in import_history(importer.store.tables()["imports"]).collect()] == [4, 3, 2, 1]


def test_enrichment(importer):
    importer(NARROW)
    r = importer(NARROW | AH | {"Time": "14:00"})
    assert (r.rows_enriched, r.odds_quotes_backfilled, r.rows_imported) == (1, 2, 0)
    m = importer.store.tables()["matches"].collect()
    assert len(m) == 1 and str(m[0].kickoff_utc) == "2025-08-17 12:00:00" and m[0].dedupe_key.endswith("12:00")


def test_coarser_copy(importer):
    importer(NARROW | {"Time": "14:00"})
    r = importer(NARROW | AH)
    assert (r.rows_duplicate, r.odds_quotes_backfilled) == (1, 2)


def test_ambiguous_copy(importer):
    assert importer(NARROW | {"Time": "12:00"}, NARROW | {"Time": "18:00", "FTHG": "2"}).rows_imported == 2
    r = importer(NARROW | AH)
    assert (r.rows_duplicate, r.odds_quotes_backfilled) == (1, 0)


def test_untimed_double_header_conflicts(importer):
    r = importer(NARROW, NARROW | {"FTHG": "2", "FTAG": "2"})
    assert (r.rows_imported, r.rows_rejected) == (1, 1)


def test_nine_rows(importer, spark, tmp_path):
    odds = {"B365H": "1.90", "B365D": "3.60", "B365A": "4.20"}
    base = {"Div": "E0", "Date": "16/08/2025", "Time": "13:30", "HTHG": "0", "HTAG": "0"}
    rows = [
        base | odds | {"HomeTeam": "Arsenal", "AwayTeam": "Chelsea", "FTHG": "2", "FTAG": "1"},
        base | odds | {"HomeTeam": "Liverpool", "AwayTeam": "Everton", "FTHG": "1", "FTAG": "1", "Time": "16:00"},
        {k: v for k, v in base.items() if k != "Time"} | {"HomeTeam": "Newcastle", "AwayTeam": "Fulham", "FTHG": "1", "FTAG": "0", "HTAG": ""},
        base | {"HomeTeam": "Brentford", "AwayTeam": "Leeds", "FTHG": "1", "FTAG": "0", "HTHG": "3"},
        base | {"HomeTeam": "Aston Villa", "AwayTeam": "Wolves", "FTHG": "0", "FTAG": "0", "B365>2.5": "0.50"},
        base | {"Div": "D1", "HomeTeam": "Köln", "AwayTeam": "Mainz", "FTHG": "4", "FTAG": "1"},
        base | odds | {"HomeTeam": "Arsenal", "AwayTeam": "Chelsea", "FTHG": "2", "FTAG": "1"},
        base | {"HomeTeam": "", "AwayTeam": "Leeds", "FTHG": "2", "FTAG": "1"},
        base | {"HomeTeam": "Arsenal", "AwayTeam": "Leeds", "FTHG": "", "FTAG": "1"},
    ]
    r = importer(*rows)
    assert (r.rows_total, r.rows_imported, r.rows_duplicate, r.rows_rejected) == (9, 6, 1, 2)
    t = importer.store.tables()
    assert sorted(x.name for x in t["leagues"].collect()) == ["Bundesliga", "Premier League"]
    assert t["matches"].filter("ht_home IS NULL").count() == 2
    assert sorted(x.id for x in t["matches"].collect()) == [1, 2, 3, 4, 5, 6]
    r = importer(*rows)
    assert (r.rows_imported, r.rows_duplicate) == (0, 7)


def test_external_ids_beat_pairings(spark, tmp_path):
    import dataclasses

    profile = dataclasses.replace(SEASON_FILES, external_id_col="Id")
    store = Store(spark, f"file://{tmp_path}/s")

    def run(name, *rows):
        names = list(dict.fromkeys(k for r in rows for k in r))
        (tmp_path / name).write_text("\n".join([",".join(names), *[",".join(r.get(n, "") for n in names) for r in rows]]))
        return import_file(spark, store, read_table(spark, f"file://{tmp_path}/{name}"), profile, name).first()

    r = run("a.csv", NARROW | {"Id": "x1"}, NARROW | AH | {"Id": "x1", "Date": "18/08/2025"})
    assert (r.rows_imported, r.rows_duplicate, r.odds_quotes_backfilled) == (1, 1, 2)
    assert run("b.csv", NARROW | {"Id": "x1", "HomeTeam": "Leeds", "PSCH": "1.9"}).rows_duplicate == 1


def test_reader_tolerates_marks_and_latin(spark, tmp_path):
    text = "\n".join([";".join([" Div ", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG"]), "E0;16/08/2025;Köln;Mainz;1;0"])
    for name, data in (("bom.csv", text.encode("utf-8-sig")), ("latin.csv", text.encode("latin-1"))):
        (tmp_path / name).write_bytes(data)
        raw = read_table(spark, f"file://{tmp_path}/{name}")
        assert raw.columns[0] == "Div" and raw.first().HomeTeam == "Köln"
        seen = preview(raw)
        assert seen["auto_apply"] and seen["rows"] == 1
    with pytest.raises(ValueError):
        read_table(spark, "x.pdf")


def test_reader_finds_late_accents(spark, tmp_path):
    lines = ["Div,HomeTeam,AwayTeam", *["E0,Arsenal,Chelsea"] * 5000, "D1,Köln,Mainz"]
    assert len("\n".join(lines[:-1])) > 65536
    for encoding in ("utf-8", "latin-1"):
        (tmp_path / f"{encoding}.csv").write_bytes("\n".join(lines).encode(encoding))
        raw = read_table(spark, f"file://{tmp_path}/{encoding}.csv")
        assert [r.HomeTeam for r in raw.filter("Div = 'D1'").collect()] == ["Köln"] and raw.count() == 5001


def test_validation_reasons(spark):
    rows = [{"HomeTeam": None}, {"AwayTeam": "NEWCASTLE"}, {"Date": "soon"}, {"FTHG": "x"}, {}]
    names = list(NARROW)
    raw = spark.createDataFrame([(i, *[(NARROW | r)[n] for n in names]) for i, r in enumerate(rows)], "row_index long, " + ", ".join(f"`{n}` string" for n in names))
    got = [r.error for r in V.validate(raw, SEASON_FILES).orderBy("row_index").collect()]
    assert got == ["missing team name", "identical teams", "bad date", "bad full-time score", None]


def test_stream_imports_each_file_once(spark, tmp_path):
    from kickmill.streaming.ingest import import_folder

    store = Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "in").mkdir()
    lines = [",".join(NARROW), ",".join(NARROW.values())]
    (tmp_path / "in/a.csv").write_text("\n".join(lines))
    for _ in range(2):
        import_folder(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp").awaitTermination()
    assert store.tables()["imports"].count() == 1


def test_versions_and_units(spark, tmp_path, monkeypatch):
    from kickmill.sources import ports
    from kickmill.sources import store as ST

    monkeypatch.setenv("KICKMILL_STORE", f"file://{tmp_path}/s")
    store = ST.open_store(spark)
    memory = MemoryTables({n: spark.createDataFrame([], s) for n, s in ST.SCHEMAS.items()})
    teams = spark.createDataFrame([("A", "a"), ("B", "b")], "canonical_name string, normalized_key string")
    for tables in (store, memory):
        assert isinstance(tables, ports.Tables)
        for _ in range(2):
            with ST.Unit(tables) as unit:
                assert isinstance(unit, ports.UnitOfWork)
                unit.add("teams", teams, ["normalized_key"])
                unit.commit()
        with ST.Unit(tables) as unit:
            unit.add("teams", teams, ["normalized_key"])
            unit.rollback()
        with ST.Unit(tables) as unit:
            unit.update("teams", spark.createDataFrame([(1, "AA")], "id long, canonical_name string"))
            unit.add("teams", spark.createDataFrame([("C", "c")], teams.schema), ["normalized_key"])
            unit.commit()
        with ST.Unit(tables) as unit:
            found = unit.get("teams", spark.createDataFrame([("a",), ("z",)], "normalized_key string"))
            assert {r.normalized_key: (r.id, r.canonical_name) for r in found.collect()} == {"a": (1, "AA"), "z": (None, None)}
        assert sorted((r.id, r.canonical_name) for r in tables.tables()["teams"].collect()) == [(1, "AA"), (2, "B"), (3, "A"), (4, "B"), (5, "C")]
    # the same number twice: the second writer fails, and its rows are not seen
    late = ST.Store(spark, store.folder)
    monkeypatch.setattr(late, "version", lambda: (0, {n: [] for n in ST.SCHEMAS}))
    with pytest.raises(Exception):
        late.commit({"teams": store.tables()["teams"]})
    assert store.tables()["teams"].count() == 5 and store.compact() == 4 and len(store.version()[1]["teams"]) == 1


def test_notes_and_report(importer):
    import json

    importer(NARROW | {"B365H": "0.5"}, NARROW | {"HomeTeam": ""}, NARROW | {"HomeTeam": "Newcastel", "Date": "18/08/2025"})
    t = importer.store.tables()
    told = json.loads(t["imports"].first().report_json)
    assert told["rows_total"] == 3 and told["rows_rejected"] == 1 and told["filename"] == "f0.csv"
    notes = sorted((r.kind, r.row_index, r.import_id) for r in t["notes"].collect())
    assert ("rejection", 1, 1) in notes and ("warning", 0, 1) in notes and sum(k == "resolution" for k, _, _ in notes) == 3
    assert t["imports"].first().created_at is not None


def test_many_files_in_one_plan_equal_one_after_another(spark, tmp_path):
    from kickmill.sources.store import import_files

    teams = ["Newcastle", "Fulham", "Newcastel", "Arsenal FC", "Arsenal", "Leeds United", "Leeds Utd"]
    frames = []
    for k in range(3):
        rows = []
        for i in range(7):
            row = NARROW | {"HomeTeam": teams[(k + i) % 7], "AwayTeam": teams[(k + 2 * i + 1) % 7], "Date": f"{17 + (i + k) % 3}/08/2025", "FTHG": str(i % 2), "B365H": str(1.9 + 0.1 * (k % 2))}
            rows.append(row | ({"Time": "14:00"} if (i + k) % 3 == 0 else {"Time": ""}))
        path = tmp_path / f"g{k}.csv"
        path.write_text("\n".join([",".join(rows[0]), *[",".join(r.values()) for r in rows]]))
        frames.append((read_table(spark, f"file://{path}"), path.name))
    one, many = Store(spark, f"file://{tmp_path}/one"), Store(spark, f"file://{tmp_path}/many")
    reports = [import_file(spark, one, raw, SEASON_FILES, name).first() for raw, name in frames]
    assert import_files(spark, many, frames, SEASON_FILES).collect() == reports and sum(r.rows_imported for r in reports) > 6
    for name in ("leagues", "teams", "matches", "odds", "sources"):
        assert sorted(map(str, one.tables()[name].collect())) == sorted(map(str, many.tables()[name].collect())), name
    keys = ("team_id", "alias", "normalized_alias", "confidence")
    assert sorted(map(str, one.tables()["aliases"].select(*keys).collect())) == sorted(map(str, many.tables()["aliases"].select(*keys).collect()))
    assert [tuple(r)[:-1] for r in import_history(one.tables()["imports"]).collect()] == [tuple(r)[:-1] for r in import_history(many.tables()["imports"]).collect()]
