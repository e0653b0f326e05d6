"""Search by the trigram table against the scan."""

from __future__ import annotations

import random
import uuid

import pytest

from ledgerflow.operators import trigrams as tg
from ledgerflow.operators.lists import search_customers
from ledgerflow.session import work_dir

SCHEMA = "name string, customer_name string, customer_group string, territory string"


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(2)
    parts = ["Toko", "Maju", "maju jaya", "PT", "ÉCLAIR", "中文字", "a%b_c", "back\\slash", "straße", "aaaa", "ΑΣ", "İstanbul"]
    rows = [(f"C{i:03d}", " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))), "g", "t") for i in range(150)]
    rows += [("Cnull", None, "g", "t"), ("Cempty", "", "g", "t"), ("Cshort", "ab", "g", "t"), (None, "Maju", "g", "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = work_dir(spark, "tests", "grams-" + uuid.uuid4().hex)
    tg.write_grams(df.where("name is null or name < 'C100'"), path, "name", "customer_name")
    tg.write_grams(df.where("name >= 'C100'"), path, "name", "customer_name", mode="append")
    return df, path


@pytest.mark.parametrize("query", ["maju", "MAJU JAYA", "ju ja", "éclair", "中文字", "aaaa", "toko%maju", "m_ju", "k\\s", "straße", "ος", "ας",
                                   "stanbul", "pt toko pt", "ab", "a", "", "%", "zzz", "maju zzz", "x" * 300])
def test_same_rows_as_the_scan(spark, stored, query):
    df, path = stored
    df = df.where("name is not null")
    for limit in (7, None):
        got = [tuple(r) for r in tg.search_customers_indexed(df, path, query, limit).collect()]
        want = [tuple(r) for r in search_customers(df, query, limit).collect()]
        assert (got if limit else sorted(got)) == (want if limit else sorted(want)), (query, limit)


def test_changed_names_are_found_under_the_new_name_only(spark, stored):
    df, path = stored
    new = spark.createDataFrame([("C001", "Warung Baru", "g", "t")], SCHEMA)
    now = df.where("name <> 'C001'").unionByName(new)
    tg.write_grams(new, path, "name", "customer_name", mode="append")
    assert [r["name"] for r in tg.search_customers_indexed(now, path, "warung").collect()] == ["C001"]
    old = df.where("name = 'C001'").first()["customer_name"]
    assert "C001" not in [r["name"] for r in tg.search_customers_indexed(now, path, old, None).collect()]


def test_a_pattern_reads_few_row_groups_and_its_rarest_grams(spark):
    assert tg.pattern_grams("ab%cdef_gh") == ["cde", "def"] and tg.pattern_grams("ab") == []
    path = work_dir(spark, "tests", "grams-" + uuid.uuid4().hex)
    df = spark.range(3000).selectExpr("concat('K', id) as name", "concat('common ', lpad(hex(id * 2654435761 % 1048576), 6, '0')) as customer_name",
                                      "'g' as customer_group", "'t' as territory")
    tg.write_grams(df, path, "name", "customer_name")
    target = df.where("name = 'K77'").first()["customer_name"]
    grams = tg.pattern_grams(target.lower())
    assert tg.candidates(spark, path, grams).count() < 20  # not the 3,000 rows that have 'com'
    plan = spark._jvm.PythonSQLUtils.explainString(tg.candidates(spark, path, grams)._jdf.queryExecution(), "formatted")
    assert "In(gram" in plan
    assert [r["name"] for r in tg.search_customers_indexed(df, path, target).collect()] == ["K77"]
