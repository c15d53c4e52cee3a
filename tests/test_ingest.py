"""Sources, mapping, cleaning, quality and publishing."""

from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from bizdiag.functions import cleaning
from bizdiag.operators import mapping, profile, quality
from bizdiag.definitions import CONSISTENCY_RULES
from bizdiag.schema import COLUMNS
from bizdiag.sources import files, tables

DIRTY = """2024-07-01," 零售 ",甲,线上," 西区 ",一组,陈一,210,40,30,25,20,6,6,"2,350.75",2,2,150
2024/07/01,零售,甲,线上,西区,一组,陈一,190,35,28,20,15,5,5,80,0,0,10
31/31/2024,批发,乙,门店,东区,二组,李二,60,12.25,9,8,7,4,4,500,1,1,20
2024-07-02,批发,乙, ,东区,,李二,70,20,22,8,7,4,4,约三百,6,5,-40
2024-07-03,零售,丙,线上,西区,一组,王三,30,45,40,41,42,44,9,90,1,1,120
"""
TEXT = ",".join(COLUMNS) + "\n" + DIRTY


@pytest.fixture
def dirty(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text(TEXT, encoding="utf-8-sig")
    raw = files.scan_csv(spark, str(path)).withColumn("row_id", F.monotonically_increasing_id())
    return mapping.standardise(mapping.apply_mapping(raw, {c: c for c in COLUMNS}, keep=["row_id"]), "row_id")


def test_dirty_rows_give_their_errors_and_warnings(dirty):
    report = quality.quality_report(dirty).first()
    assert (report.is_valid, report.blocking_count, report.warning_count, report.info_count, report.row_count) == (False, 4, 19, 0, 5)
    found = quality.quality_issues(dirty).collect()
    assert {r.code for r in found if r.severity == "ERROR"} == {
        "invalid_date", "invalid_numeric", "non_integer_count", "duplicate_canonical_grain",
    }
    assert {r.field for r in found if r.code == "negative_value"} == {"refund_amount"}
    assert {rule for _, _, rule in CONSISTENCY_RULES} <= {r.code for r in found}  # each of the eight fires
    assert next(r for r in found if r.code == "duplicate_canonical_grain").affected_count == 2


def test_samples_are_bounded_and_ordered(dirty):
    rows = quality.issue_samples(dirty, "row_id", 2).where("code = 'invalid_numeric'").collect()
    assert {(r.field, r.sample, r.text) for r in rows} == {("gross_revenue", "row", "3"), ("gross_revenue", "value", "约三百")}
    assert quality.issue_samples(dirty, "row_id", 1).where("position > 1").count() == 0


def test_samples_of_duplicates_and_of_an_exceeded_ratio(spark):
    """A grain of a third of the rows, NULL equal to NULL; the ratio's samples are the rows of the NULLs."""
    cells = [(str(i), "2024-07-01" if i % 3 == 0 else f"2024-08-{i % 28 + 1:02d}", None if i % 3 == 0 else f"c{i}", "1") for i in range(60)]
    raw = spark.createDataFrame(cells, "row_id string, date string, channel string, leads string")
    s = mapping.standardise(mapping.apply_mapping(raw, {c: c for c in ("date", "channel", "leads")}, keep=["row_id"]), "row_id")
    got = {}
    for r in quality.issue_samples(s, "row_id", 4).orderBy("position").collect():
        got.setdefault((r.code, r.field, r.sample), []).append(r.text)
    assert got["duplicate_canonical_grain", None, "row"] == ["0", "3", "6", "9"]
    assert got["duplicate_canonical_grain", None, "value"] == ["2024-07-01|"] * 4
    assert got["missing_ratio_exceeded", "channel", "row"] == got["mapped_field_nulls", "channel", "row"] == ["0", "3", "6", "9"]
    assert ("missing_ratio_exceeded", "channel", "value") not in got and ("missing_ratio_exceeded", "leads", "row") not in got
    lenient = {"missing_warning_threshold": 0.5, "duplicate_check_enabled": False}
    assert {r.code for r in quality.issue_samples(s, "row_id", 4, lenient).collect()} == {"mapped_field_nulls"}


def test_encodings_are_decided_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEXT, encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text(TEXT, encoding="gb18030")
    rows = files.scan_csv_any_encoding(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and rows[0].asDict().keys() == {*COLUMNS, "source_file"}
    seen = {name: sorted(str(r.asDict() | {"source_file": ""}) for r in rows if r.source_file.endswith(name)) for name in ("a.csv", "b.csv")}
    assert seen["a.csv"] == seen["b.csv"]


def test_mapping_is_rejected_before_any_job(spark):
    df = spark.createDataFrame([("2025-01-01", "1", "x")], "d string, n string, extra string")
    cases = {
        "missing_required_date": {"leads": "n"}, "unknown_canonical_field": {"date": "d", "lead": "n"},
        "missing_source_field": {"date": "d", "leads": "m"}, "duplicate_source_field": {"date": "d", "leads": "d"},
        "duplicate_canonical_field": [("date", "d"), ("date", "n")],
    }
    for code, fields in cases.items():
        with pytest.raises(mapping.InvalidMapping) as e:
            mapping.apply_mapping(df, fields)
        assert code in e.value.codes
    assert mapping.apply_mapping(df, {"leads": "n", "date": "d"}).columns == ["date", "leads"]
    warnings = {i[1] for i in mapping.mapping_issues({"date": "d"}, df.columns)}
    assert warnings == {"unmapped_source_fields", "unmapped_optional_canonical_fields"}


def test_cleaning(spark):
    def clean(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v

    as_date = lambda c: cleaning.date_col(c)[0]
    for text in ("2025-01-02", "2025/1/2", "2025.01.02", "20250102", "2025年1月2日", "2025-01-02 10:20:30", "45659", "45659.5", "1/2/2025", " 2025-01-02T00:00:00 "):
        assert clean(text, as_date) == date(2025, 1, 2), text
    for text in ("1/2/2025 10:30", "January 2, 2025", "2-Jan-2025", "jan 2, 2025 3:04 PM", "　2025/1/2\u00a0"):
        assert clean(text, as_date) == date(2025, 1, 2), text
    for text in ("", "  ", "　", "x", "2025-13-01", "2025-02-30"):
        assert clean(text, as_date) is None
    count = lambda c: cleaning.number_col(c, "count")[0]
    money = lambda c: cleaning.number_col(c, "money")[0]
    assert clean("1,234.0", count) == 1234 and clean("9007199254740993", count) == 9007199254740993
    for text in ("1e30", "99999999999999999.5"):  # beyond the type: lost, so invalid
        assert clean(text, money) is None and clean(text, lambda c: cleaning.number_col(c, "money")[1])
    assert clean("　北京　", cleaning.dimension_col) == "北京" and clean("账期1998/11", cleaning.month_col) == "1998-11"
    assert clean("1.5", count) is None and clean("inf", money) is None and clean("nan", money) is None
    assert str(clean("￥ 1,234.50", money)) == "1234.50" and clean("1e3", count) == 1000
    assert clean(" 123.0 ", cleaning.identifier_col) == "123" and clean("00123", cleaning.identifier_col) == "00123"
    assert clean("  ", cleaning.identifier_col) is None
    assert clean(" 某 商贸有限公司", cleaning.name_col) == "某商贸"
    assert clean("账期 2026/05", cleaning.month_col) == "2026-05" and clean("202605.0", cleaning.month_col) == "2026-05"
    assert clean("none", cleaning.month_col) is None
    assert clean("1,000.5", cleaning.lenient_number_col) == 1000.5 and clean("-", cleaning.lenient_number_col) is None


def test_unmapped_and_empty_frames(spark):
    one = mapping.standardise(spark.createDataFrame([("2025-01-01", None), ("2025-01-02", "A")], "date string, channel string"))
    assert quality.quality_report(one).first().is_valid
    codes = {r.code for r in quality.quality_issues(one).collect()}
    assert {"unmapped_optional_field", "mapped_field_nulls", "missing_ratio_exceeded"} == codes
    none = mapping.standardise(spark.createDataFrame([], "date string"))
    assert "empty_data" in {r.code for r in quality.quality_issues(none).collect()}
    undated = mapping.standardise(spark.createDataFrame([("A",)], "channel string"))
    assert "missing_required_date" in {r.code for r in quality.quality_issues(undated).collect()}
    with pytest.raises(ValueError):
        mapping.standardise(spark.createDataFrame([("A",)], "other string"))


def test_publish_is_gated_and_versioned(spark, dirty, fact, tmp_path):
    path = str(tmp_path / "fact")
    with pytest.raises(tables.QualityBlocked):
        tables.publish_fact(dirty.frame, quality.quality_report(dirty), path, {})
    for leads in (1, 2):
        s = mapping.standardise(fact([dict(date="2025-01-01", channel="A", leads=leads)]).select("date", "channel", "leads"))
        n = tables.publish_fact(s.frame, quality.quality_report(s), path, {c: c for c in s.mapped})
        assert n == 1
    assert tables.read_fact(spark, path).first().leads == 2
    assert tables.read_fact(spark, path).columns == list(COLUMNS)
    assert tables.metadata(spark, path).first().row_count == 1
    found = tables.availability(spark, path)
    assert [r.canonical_field for r in found.collect()] == list(COLUMNS)
    assert tables.available_fields(found) == {"date", "channel", "leads"}
    with pytest.raises(Exception, match="availability lacks"):
        tables.checked_availability(found.where("canonical_field <> 'team'")).collect()


def test_of_two_writers_that_follow_one_version_one_fails_cleanly(spark, fact, tmp_path):
    path = tmp_path / "fact"

    def publish(leads, after=None):
        s = mapping.standardise(fact([dict(date="2025-01-01", channel="A", leads=leads)]).select("date", "channel", "leads"))
        return tables.publish_fact(s.frame, quality.quality_report(s), str(path), {"leads": "leads"}, after)

    with pytest.raises(FileNotFoundError):
        tables.read_fact(spark, str(path))
    publish(1)
    seen = tables.current_number(spark, str(path))
    assert seen == 1

    def attempt(leads):
        try:
            return publish(leads, seen) and leads
        except tables.PublishConflict:
            return None

    with ThreadPoolExecutor(2) as pool:
        done = [x for x in pool.map(attempt, (2, 3)) if x]
    assert len(done) == 1
    assert tables.read_fact(spark, str(path)).first().leads == done[0]
    assert attempt(9) is None  # late, though no one is writing any more
    assert tables.read_fact(spark, str(path)).first().leads == done[0]
    # what the losers wrote is gone: two versions, two manifests, no draft
    assert len(list((path / "versions").iterdir())) == 2
    assert sorted(p.name for p in (path / "manifests").iterdir() if not p.name.endswith(".crc")) == [f"{n:020d}" for n in (1, 2)]
    publish(4)
    assert tables.current_number(spark, str(path)) == 3 and tables.read_fact(spark, str(path)).first().leads == 4


def test_checked_scans(spark):
    df = spark.createDataFrame([("2026-01", "A"), ("2026-01", "A")], "month string, merchant_key string")
    with pytest.raises(ValueError, match="lacks columns"):
        tables.scan_checked(df, ["month", "gmv"])
    with pytest.raises(Exception, match="duplicate key"):
        tables.scan_checked(df, ["month"], ["month", "merchant_key"]).collect()
    assert tables.scan_checked(df.distinct(), ["month"], ["month", "merchant_key"]).count() == 1
    pairs = spark.createDataFrame([("a", "b"), ("a", "b")], "previous_period string, current_period string")
    assert tables.single_pair(pairs).count() == 1
    with pytest.raises(Exception, match="exactly one"):
        tables.single_pair(pairs.unionByName(spark.createDataFrame([("b", "c")], pairs.schema))).collect()


def test_pairs_of_groups_and_mart_columns(spark, tmp_path):
    schema = "m string, previous_month string, current_month string"
    df = spark.createDataFrame([("a", "1", "2"), ("a", "1", "2"), ("b", None, "3"), (None, "4", "5")], schema)
    months = ("previous_month", "current_month")
    assert {tuple(r) for r in tables.single_pair(df, months, ["m"]).collect()} == {("a", "1", "2"), ("b", None, "3"), (None, "4", "5")}
    with pytest.raises(Exception, match="exactly one"):
        tables.single_pair(df.unionByName(spark.createDataFrame([("b", "2", "3")], schema)), months, ["m"]).collect()
    with pytest.raises(Exception, match="exactly one"):
        tables.single_pair(df.limit(0), months).collect()
    assert tables.single_pair(df.limit(0), months, ["m"]).collect() == []
    path = str(tmp_path / "mart")
    tables.write_mart(df, path)
    with pytest.raises(ValueError, match="customer contribution lacks columns.*customer_key"):
        tables.scan_mart(spark, path, "customer contribution")


def test_profile(spark):
    rows = [("13800138000", "2024年3月5日", None), ("x" * 50, "2024-02", ""), ("x" * 50, "n/a", "11010119900307123X")]
    df = spark.createDataFrame(rows, "name string, `日期` string, id string")
    got = {r.field: r for r in profile.profile(df).collect()}
    assert (got["name"].unique_count, got["name"].non_null_rate) == (2, 1.0)
    assert (got["日期"].first_date, got["日期"].last_date) == (date(2024, 2, 1), date(2024, 3, 5))
    assert got["id"].non_null_count == 1
    samples = {r.field: r["sample"] for r in profile.masked_samples(df, 1).collect()}
    assert samples["name"] == "<PHONE_MASKED>" and samples["id"] in ("<ID_MASKED>", "<PHONE_MASKED>")
    assert profile.duplicate_rows(df.unionByName(df)).first().duplicate_rows == 3


def test_import_in_one_call_and_pruned_reads(spark, tmp_path):
    from bizdiag.plans import imports

    (tmp_path / "in").mkdir()
    rows = ["日期,渠道,线索", "2024-05-30,网站,5", "2024-06-02,门店,NA", "2024/07/04,网站,9"]
    (tmp_path / "in" / "x.csv").write_text("\n".join(rows) + "\n", encoding="gb18030")
    path = str(tmp_path / "fact")
    fields = {"date": "日期", "channel": "渠道", "leads": "线索"}
    assert imports.import_csv(spark, str(tmp_path / "in"), fields, path) == 3
    part = tables.read_fact(spark, path, start="2024-06-01", end="2024-06-30")
    assert [(str(r.date), r.channel, r.leads) for r in part.collect()] == [("2024-06-02", "门店", None)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in filters and "2024-06" in filters
    (tmp_path / "in" / "x.csv").write_text("\n".join([*rows, "坏,网站,1"]) + "\n", encoding="gb18030")
    with pytest.raises(tables.QualityBlocked):
        imports.import_csv(spark, str(tmp_path / "in"), fields, path)
    assert tables.read_fact(spark, path).count() == 3


def test_every_blank_character_is_trimmed_and_removed(spark):
    text = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    a = F.concat("c", F.lit("x"), "c", F.lit("y"), "c", "c")
    df = spark.createDataFrame([(c,) for c in text], "c string")
    by_pattern = F.regexp_replace(a, rf"^{cleaning.BLANK}+|{cleaning.BLANK}+$", ""), F.regexp_replace(a, f"{cleaning.BLANK}+", "")
    wrong = df.where((cleaning.trimmed(a) != by_pattern[0]) | (cleaning.compact_col(a) != by_pattern[1]))
    assert wrong.count() == 0
    plan = df.select(cleaning.trimmed(a), cleaning.compact_col(a))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # a pattern for each cell was most of the time of typing


def test_cells_are_parsed_once_for_all_checks(spark):
    rows = [("1", "2025-01-01", "5"), ("2", "bad", "1.5"), ("3", "2025-01-01", "x")]
    df = spark.createDataFrame(rows, "row_id string, date string, leads string")
    lazy, s = mapping.standardise(df, "row_id"), mapping.standardise(df, "row_id", once=True)
    for a, b in ((lazy.frame, s.frame), (lazy.bad_cells, s.bad_cells)):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert "Scan ExistingRDD" not in b._jdf.queryExecution().executedPlan().toString()
    assert quality.quality_issues(lazy).exceptAll(quality.quality_issues(s)).count() == 0


def test_days_with_the_year_first_and_a_time(spark):
    cases = {
        "2025/02/28 23:59:59": date(2025, 2, 28), "2025-02-28 00:00": date(2025, 2, 28), "2025/02/28": date(2025, 2, 28),
        "2025/02/30 10:00:00": None, "2025/02/28 25:00:00": None, "2025-13-01": None,
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", *cleaning.date_col(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases and all(r[2] == (cases[r[0]] is None) for r in got)
    plan = spark.createDataFrame([("x",)], "t string").select(cleaning.date_col(F.col("t"))[0])._jdf.queryExecution().optimizedPlan().toString()
    assert cleaning.PLAIN_DAY in plan
