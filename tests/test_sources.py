import json

from pyspark.sql import functions as F

from gridhour.registry import TableSpec
from gridhour.sources import gas_index, indicators, market_files, schemas, tables, trades


def market_text(labels, es, pt=None, day="14/08/2026"):
    lines = [f"OMIE - Mercado;Fecha Emision :13/08/2026 - 13:49;;{day};x;", "", ";" + ";".join(labels) + ";"]
    lines.append("Precio marginal en el sistema español (EUR/MWh);" + ";".join(es) + ";")
    if pt:
        lines.append("Precio marginal en el sistema portugués (EUR/MWh);" + ";".join(pt) + ";")
    return "\r\n".join(lines)


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")


HOURS = [str(h) for h in range(1, 25)]
QUARTERS = [f"H{h}Q{q}" for h in range(1, 25) for q in range(1, 5)]


def test_label_order_does_not_matter(spark):
    values = {label: f"{i},5" for i, label in enumerate(QUARTERS)}
    shuffled = QUARTERS[::-1][10:] + QUARTERS[::-1][:10]
    df = files(spark, market_text(QUARTERS, [values[x] for x in QUARTERS]), market_text(shuffled, [values[x] for x in shuffled]))
    prices = market_files.hourly_prices(market_files.parse(df)).collect()
    by = {(r.file, r.hour): r.es_omie for r in prices}
    assert len(by) == 48 and all(by[("f0", h)] == by[("f1", h)] for h in range(1, 25))
    assert float(by[("f0", 1)]) == 2.0
    assert min(r.ts for r in prices).isoformat() == "2026-08-13T22:00:00"


def test_half_up_mean_of_quarters(spark):
    es = ["0"] * 96
    es[0:4] = ["0,01", "0,01", "0,00", "0,00"]
    row = [r for r in market_files.hourly_prices(market_files.parse(files(spark, market_text(QUARTERS, es)))).collect() if r.hour == 1]
    assert str(row[0].es_omie) == "0.01"


def test_rejected_files_name_their_reason(spark):
    es = ["1,0"] * 24
    df = files(
        spark,
        market_text(HOURS, es),
        market_text(HOURS[:-1], es[:-1]),
        market_text(HOURS[:-1] + ["23"], es),
        market_text(HOURS, es, day="14-08-2026"),
        "nothing;here",
        market_text(HOURS[:-1], es),
    )
    got = {r.file: r.reason for r in market_files.parse(df).select("file", "reason").collect()}
    assert got["f0"] is None
    assert got["f1"] == "number of values fits neither format"
    assert got["f2"] == "labels do not cover the day"
    assert got["f3"] == "other delivery date" and got["f4"] == "other delivery date"
    assert got["f5"] == "header missing or of other length"


def test_portuguese_line_of_other_length_is_left_empty(spark):
    df = files(spark, market_text(HOURS, ["1,0"] * 24, ["2,0"] * 23), market_text(HOURS, ["1,0"] * 24, ["2,0"] * 24))
    got = {r.file: r.pt_omie for r in market_files.hourly_prices(market_files.parse(df)).where("hour = 3").collect()}
    assert got["f0"] is None and float(got["f1"]) == 2.0


def test_market_files_are_read_as_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(market_text(HOURS, ["1,0"] * 24).encode("latin-1"))
    parsed = market_files.parse(market_files.read_files(spark, str(tmp_path)))
    assert parsed.first().reason is None


def test_clock_change_day_needs_25_labels(spark):
    labels = [str(h) for h in range(1, 26)]
    df = files(spark, market_text(labels, ["1,0"] * 25, day="27/10/2024"), market_text(HOURS, ["1,0"] * 24, day="27/10/2024"))
    got = {r.file: r.reason for r in market_files.parse(df).collect()}
    assert got["f0"] is None and got["f1"] is not None


def test_indicator_documents(spark, tmp_path):
    doc = {"indicator": {"id": 7, "name": "x", "values": [
        {"datetime": "2024-06-12T00:00:00+02:00", "value": 1.5, "geo_id": 8741, "geo_name": "Península"},
        {"datetime": "2024-06-12T01:00:00+02:00", "datetime_utc": "2024-06-11T23:00:00Z", "value": 2.5, "geo_id": None},
        {"datetime": "2024-06-12T02:00:00+02:00", "value": None, "geo_id": 8741},
        {"datetime": "bad", "value": 9.0, "geo_id": 8741},
        {"datetime": "2024-06-12T03:00:00+02:00", "value": 4.0, "geo_id": 3},
    ]}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = indicators.flatten(indicators.read_documents(spark, str(tmp_path)))
    got = sorted((r.ts.isoformat(), r.value) for r in rows.collect())
    assert got == [("2024-06-11T22:00:00", 1.5), ("2024-06-11T23:00:00", 2.5), ("2024-06-12T01:00:00", 4.0)]
    assert indicators.peninsular(rows).count() == 1 and indicators.peninsular(rows, allow_missing=True).count() == 2


def test_trades_are_cleaned_and_rejects_kept(spark, tmp_path):
    raw = [
        {"tradeId": "a", "dealDate": 1704103200000000000, "price": 10.0005, "quantity": 3, "aggressorBuy": True, "venueCode": "v"},
        {"tradeId": "b", "dealDate": 1704103200000, "price": "12.3", "quantity": None},
        {"tradeId": "c", "dealDate": 1704103200, "price": 5000},
        {"tradeId": "", "dealDate": 1704103200, "price": 1},
        {"tradeId": "d", "price": 1},
        {"tradeId": "e", "dealDate": 1704103200, "price": "x"},
    ]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(r) for r in raw))
    df = trades.read_trades(spark, str(tmp_path))
    got = {r.trade_id: (r.deal_date.isoformat(), float(r.precio), r.cantidad, r.agresor_compra) for r in trades.clean(df).collect()}
    assert got == {"a": ("2024-01-01T10:00:00", 10.001, 3, True), "b": ("2024-01-01T10:00:00", 12.3, 0, False)}
    counts = trades.clean_counts(df).first()
    assert (counts.n_kept, counts.n_rejected) == (2, 4) and trades.rejected(df).count() == 4


def test_gas_index_picks_its_column_and_first_row_per_day(spark):
    rows = [("01/02/2024", "1", "25.1234", 1), ("1/2/2024", "1", "99", 2), ("x", "1", "1", 3), ("02/02/2024", "1", "-", 4), ("2024-02-03", "1", "30", 5)]
    df = spark.createDataFrame(rows, ["Delivery day", "MIBGAS LNG Index", "MIBGAS Index [EUR/MWh]", "row"])
    got = {r.fecha.isoformat(): r.gas_mibgas for r in gas_index.clean(df, ["row"]).collect()}
    assert got == {"2024-02-01": 25.123, "2024-02-03": 30.0}
    assert gas_index.price_column(["a", "MIBGAS AVERAGE INDEX"]) is None


def test_price_columns_are_discovered_from_the_table(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "datetime int, es_omie double, de_lu_entsoe double, at_esios double, note double")
    used, ignored = tables.discover_prices(df, "datetime")
    assert used == ["es_omie", "de_lu_entsoe"] and ignored == ["at_esios", "note"]


def test_tables_are_normalised_written_by_month_and_evolve(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-31 23:00:00' AS ts, 1.0D AS v, 'x' AS updated_at UNION ALL SELECT timestamp'2024-02-01 00:00:00', 2.0D, 'y'")
    norm = tables.normalize_time(df, TableSpec("ts", "p", "hourly"))
    assert norm.columns == ["ts_utc", "p_v"]
    path = str(tmp_path / "h")
    tables.write_hourly(norm, path, "ts_utc")
    tables.write_hourly(norm.where("p_v = 2").withColumn("p_v", F.lit(5.0)), path, "ts_utc")
    got = {r.month: r.p_v for r in spark.read.parquet(path).collect()}
    assert got == {"2024-01": 1.0, "2024-02": 5.0}
    wider = schemas.conform(spark.read.parquet(path), "ts_utc TIMESTAMP, p_v DOUBLE, extra DOUBLE")
    assert wider.where("extra IS NULL").count() == 2


def test_nan_of_other_tools_is_read_as_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "ts int, v double").write.parquet(path)
    assert tables.scan(spark, path, "ts", ("v",)).where("v IS NOT NULL").count() == 1


def test_range_scan_includes_the_last_day(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-31 13:00:00' AS ts UNION ALL SELECT timestamp_ntz'2024-02-01 00:00:00'")
    assert tables.between(df, "ts", "2024-01-01", "2024-01-31").count() == 1
    assert tables.between(df, "ts", "2024-01-01", "2024-01-31", last_day=False).count() == 0
