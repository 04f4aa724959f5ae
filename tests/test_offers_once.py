"""Facts and prices of an offer are made once for each title and text, not for each row."""

import pytest

from faircart.operators import normalize
from faircart.plans import catalogue

CARDS = [
    ("Cat Litter, 20 lb", "now $10.00", None), ("Cat Litter, 20 lb", "was $30 now $20.00 $1.00/lb", "price $20.00"), ("Cat Litter", "20 lb bag, now $10.00", None), ("Cat Litter 5 lb", "", None),
    (None, "$3.00 12 oz", None), ("Vinegar, 1 gal", None, "$2.56"), ("Vinegar, 1 gal", None, None), ("Water 12 pack, 16 fl oz bottles", "$6.00 $0.50/fl oz", None), ("Water, 16 fl oz", "12 pack $6.00", None),
    ("Litter, 10 lb", "$5.00 90¢/lb", None), ("", "", ""), ("Cat Litter, 20 lb", "now $12.00", "now $10.00"),
]


@pytest.mark.parametrize("name", ("part_unit_price", "lowest_of_n"))
def test_rows_are_only_joined_with_what_is_known(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not any(word in plan for word in ("rlike", "regexp", "format_number", "lambda"))


@pytest.mark.parametrize("few", (20_000, 0))
def test_odd_cards(spark, monkeypatch, few):
    monkeypatch.setattr(normalize, "FEW", few)
    rows = spark.createDataFrame([(i, k, "old", *c) for i, c in enumerate(CARDS) for k in range(2)], "id long, k int, package string, title string, card_text string, price_text string")
    got = normalize.extract(rows).select("id", "choice", "price_cents", "pack_count", "normalized.cents", "normalized.display", "normalized.explanation", "warnings")
    want = [
        (0, "package", 1000, None, 50.0, "50¢/lb", "$10.00 / 20 lb", []),
        (1, "native", 2000, None, 100.0, "$1.00/lb", "Visible unit price $1.00/lb", []),
        (2, "package", 1000, None, 50.0, "50¢/lb", "$10.00 / 20 lb", []),
        (5, "package", 256, None, 2.0, "2¢/fl oz", "$2.56 / 1 gal", ["Converted from gal."]),
        (8, "package", 600, 12, 3.125, "3.13¢/fl oz", "$6.00 / 192 fl oz", ["Multi-pack detected: 12 pack."]),
        (11, "package", 1000, None, 50.0, "50¢/lb", "$10.00 / 20 lb", []),
    ]
    assert sorted(map(tuple, got.collect())) == [w for w in want for _ in range(2)]
