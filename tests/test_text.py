"""Text forms on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from kinmark.functions import text as tx

NAMES = {
    "Café Étienne SARL": "cafe etienne sarl",
    "Foo a/k/a Bar d/b/a Baz LLC": "bar d b a baz llc",
    "foo AKA: bar": "bar",
    "www.mumbaicure.com": "mumbaicure",
    "@acme - 12345": "acme 12345",
    "½ & ﬁrst œuvre": "1 2 and first uvre",
    "L.L.C.": "l l c",
    "": "",
}
ADDRESSES = {"½ Main St": "1 2 main st", "<NULL>, 512-516 Elm": "512 516 elm", "Hn 835-": "hn 835", "null none x": "x", "000": "000"}


@pytest.mark.parametrize(("form", "rows"), [(tx.name_form, NAMES), (tx.address_form, ADDRESSES)])
def test_forms(spark, form, rows):
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r[0]: r[1] for r in df.select("t", form(F.col("t"))).collect()} == rows


def test_nukta_letters_stay_decomposed(spark):
    df = spark.createDataFrame([("क़",)], "t string")
    assert df.select(tx.fold(F.col("t"))).first()[0] == "क़"


def test_tokens_and_views(spark):
    row = [("S1-1", "The Big Big Trading Company Ltd", "Unit 007, 512-516 Elm Road, 000 a bc")]
    r = tx.with_forms(spark.createDataFrame(row, "entity_id string, business_name string, business_address string")).first()
    assert r["name_core"] == "big big trading" and r["name_toks"] == ["big", "trading"] and r["name_key"] == "big trading"
    assert r["name_core_nospace"] == "bigbigtrading"
    assert r["addr_toks"] == ["elm", "bc"] and r["addr_nums"] == ["7", "512", "516"]
    assert not r["name_nonascii"]


def test_comma_list_and_script(spark):
    df = spark.createDataFrame([("",), ("a",), ("a,b",)], "t string")
    assert [len(r[0]) for r in df.select(tx.comma_list(F.col("t"))).collect()] == [0, 1, 2]
    got = [r[0] for r in spark.createDataFrame([("12",), ("é",), ("1 मुंबई",), ("漢字",), ("한국",), ("Привет",)], "t string").select(tx.script(F.col("t"))).collect()]
    assert got == ["NONE", "LATIN", "DEVANAGARI", "HAN", "HANGUL", "CYRILLIC"]
