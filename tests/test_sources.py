import hashlib
import json

import pytest

from weekwatch.operators import joins
from weekwatch.sources import bulletin_files, case_csv, climate_index, sql_dump, tables, weather_json, writers

HEADER = ",".join(case_csv.COLUMNS)


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def aborts(frame, message):
    """The plan is made without looking at rows; the job that reads them fails."""
    with pytest.raises(Exception, match=message):
        frame.count()


def row(place="X", year=2014, start="2014-01-05", end="2014-01-11", s="Admin0", t="Week", definition="Total", n="7"):
    return f"{place},{year},{start},{end},{s},{t},{definition},{n}"


FILTERS = {"S_res": "Admin0", "T_res": "Week"}


def test_national_weeks_skip_other_resolutions_and_stop_on_definitions(spark, tmp_path):
    path = write(tmp_path, "a.csv", [HEADER, row(), row(s="Admin1", definition="Raro"), row(t="Month")])
    assert [r.conteo for r in case_csv.national_weeks(spark, path).collect()] == [7]
    bad = write(tmp_path, "b.csv", [HEADER, row(definition="Sospechoso")])
    aborts(case_csv.national_weeks(spark, bad), "unexpected case definition: adm_0_name=X")


def test_columns_are_found_by_name(spark, tmp_path):
    names = case_csv.COLUMNS[::-1] + ("extra",)
    values = dict(zip(case_csv.COLUMNS, row().split(","))) | {"extra": "1"}
    path = write(tmp_path, "r.csv", [",".join(names), ",".join(values[n] for n in names)])
    assert [(r.pais, r.conteo) for r in case_csv.national_weeks(spark, path).collect()] == [("X", 7)]
    assert [r.valor for r in case_csv.lenient_weeks(spark, path, [2014]).collect()] == [7.0]
    short = write(tmp_path, "s.csv", ["adm_0_name,Year", "X,2014"])
    with pytest.raises(tables.SourceContractError):
        case_csv.national_weeks(spark, short)


def test_blank_cells_and_absent_countries_break_the_contract(spark, tmp_path):
    aborts(case_csv.national_weeks(spark, write(tmp_path, "n.csv", [HEADER, row(definition="")])), "unexpected case definition")
    aborts(case_csv.strict_weeks(spark, write(tmp_path, "m.csv", [HEADER, row(end="")]), FILTERS, 2014, 2014), "not seven days")
    good = write(tmp_path, "o.csv", [HEADER, row()])
    for frozen in ({"X": 1, "Y": 1}, {"Y": 1}, {"X": 2}):
        aborts(case_csv.strict_weeks(spark, good, FILTERS, 2014, 2014, frozen), "row count differs")
    # also when no row of the years is left to carry the contract
    aborts(case_csv.strict_weeks(spark, good, FILTERS, 1990, 1991, {"X": 1}), "row count differs")


def _response(days=1, **changed):
    daily = {"time": ["2020-01-0%d" % (i + 1) for i in range(days)]} | {n: [1.0] * days for n in weather_json.VARIABLES}
    return {"latitude": 1.0, "longitude": 2.0, "elevation": 3.0, "daily": daily | changed}


@pytest.mark.parametrize("body,places,good", [
    (json.dumps([_response(), _response(2)]), 2, True),
    (json.dumps([_response(), _response()]), 1, False),
    (json.dumps([_response()]), 2, False),
    ("{not json", 1, False),
    (json.dumps([_response(2, precipitation_sum=[1.0])]), 1, False),
    (json.dumps([_response(1, dew_point_2m_mean=None)]), 1, False),
])
def test_weather_responses_meet_their_locations(spark, tmp_path, body, places, good):
    folder = tmp_path / "lote=0"
    folder.mkdir()
    (folder / "a.json").write_text(body, encoding="utf-8")
    locations = spark.createDataFrame([(0, i, 10 + i) for i in range(places)], "lote int, posicion int, region int")
    if good:
        assert weather_json.responses(spark, str(tmp_path), locations).count() == places
    else:
        aborts(weather_json.responses(spark, str(tmp_path), locations), "do not meet|missing or of unequal length")


def test_lenient_weeks_keep_the_last_row_of_a_date(spark, tmp_path):
    path = write(tmp_path, "c.csv", [HEADER, row(n="9"), row(n="NA"), row(n="3"), row(year="x")])
    assert [r.valor for r in case_csv.lenient_weeks(spark, path, [2014]).collect()] == [3.0]


def test_strict_weeks_contract(spark, tmp_path):
    good = write(tmp_path, "d.csv", [HEADER, row(year=2013, start="2013-12-29", end="2014-01-04"), row()])
    got = case_csv.strict_weeks(spark, good, FILTERS, 2014, 2014, {"X": 2}).orderBy("fecha").collect()
    assert [(r.anio, r.semana, r.anio_declarado) for r in got] == [(2014, 1, 2013), (2014, 2, 2014)]
    for lines in ([row(end="2014-01-12")], [row(), row()]):
        broken = case_csv.strict_weeks(spark, write(tmp_path, f"e{len(lines)}.csv", [HEADER, *lines]), FILTERS, 2014, 2014)
        aborts(broken, "not seven days|duplicate week")
    aborts(case_csv.strict_weeks(spark, good, FILTERS, 2014, 2014, {"X": 3}), "row count differs")


def test_climate_index_skips_malformed_lines(spark, tmp_path):
    path = write(tmp_path, "oni.txt", [" SEAS  YR   TOTAL   ANOM", " DJF 1995  26.5   0.9", "XXX 1995 1 2", "roto", "NDJ 1995 25.0 -1.2"])
    got = {(r.anio, r.mes): r.anom for r in climate_index.read(spark, path).collect()}
    assert got == {(1995, 1): 0.9, (1995, 12): -1.2}


def test_dump_block(spark, tmp_path):
    lines = ["-- x", "COPY public.uno (a, b) FROM stdin;", "1\tx", "2\t\\N", "\\.", "COPY public.dos (a) FROM stdin;", "9", "\\."]
    dump = sql_dump.lines(spark, write(tmp_path, "seed.sql", lines))
    got = sql_dump.table(dump, "uno", {"a": (0, "int"), "b": (1, "string")}).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x"), (2, None)]
    with pytest.raises(sql_dump.DumpError):
        sql_dump.table(dump, "tres", {"a": (0, "int")})
    cut = sql_dump.lines(spark, write(tmp_path, "cut.sql", lines[:4]))
    with pytest.raises(sql_dump.DumpError):
        sql_dump.block(cut, "uno")


def test_bulletin_files_give_pages(spark, tmp_path):
    folder = tmp_path / "2019"
    folder.mkdir()
    (folder / "Boletin_SE05-06_v2.pdf.txt").write_text("uno\ndos\ftres", encoding="utf-8")
    got = bulletin_files.pages(spark, str(tmp_path)).orderBy("pagina").collect()
    assert [(r.anio, r.semana_archivo, r.version, r.pagina, r.texto) for r in got] == [
        (2019, "5-6", 2, 0, "uno\ndos"), (2019, "5-6", 2, 1, "tres"),
    ]


def test_fingerprint_gate(spark, tmp_path):
    path = write(tmp_path, "fuente.csv", ["a", "b"])
    digest = hashlib.sha256(b"a\nb\n").hexdigest()
    writers.require_fingerprints(spark, path, {"fuente.csv": digest})
    with pytest.raises(writers.FingerprintMismatch):
        writers.require_fingerprints(spark, path, {"fuente.csv": "0" * 64})
    with pytest.raises(writers.FingerprintMismatch):
        writers.require_fingerprints(spark, path, {"otra.csv": digest})


def test_fact_writer_replaces_only_the_years_it_brings(spark, tmp_path):
    path = str(tmp_path / "hechos")
    frame = lambda rows: spark.createDataFrame(rows, "conteo int, anio int")
    writers.facts(frame([(1, 2019), (2, 2020)]), path)
    writers.facts(frame([(5, 2020)]), path)
    assert sorted((r.anio, r.conteo) for r in spark.read.parquet(path).collect()) == [(2019, 1), (2020, 5)]


def test_required_lookup_stops_before_use(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "k string")
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id int")
    with pytest.raises(joins.UnmatchedRows):
        joins.require_match(rows, dim, ["k"])
    with pytest.raises(joins.UnmatchedRows):
        joins.require_all(dim, rows.filter("k = 'a'"), ["k"])
