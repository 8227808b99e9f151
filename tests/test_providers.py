"""Providers' documents with names and types of all sorts."""

import json

from furlong.sources import providers


def rows(spark, docs):
    good, bad = providers.documents(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string"))
    return good, sorted(r.value for r in bad.collect())


def test_race_documents(spark):
    docs = [
        {"race_id": 5, "off_time": "2024-05-01T14:30:00", "course": "York", "type": "NH", "dist_f": "8.5", "class": 2, "field_size": 9, "is_handicap": True, "other": {"x": [1]}, "runners": [{"horse": "A", "ofr": None, "or": "77", "stall": 3.0, "lbs": "130", "non_runner": True}, {"horse": "B", "rating": "high", "sex": None, "sex_code": "f"}]},
        {"id": "x", "off_dt": "01/05/2024", "course": None, "type": "dressage", "runners": [{"horse_id": 1}]},
        {"off_time": "2024-05-02", "runners": []}, {"off_time": "2024-05-03"}, {"off_time": "2024-05-04", "runners": "none"},
    ]
    good, bad = rows(spark, [*docs, "{broken", "[1]", "3", "", "null"])
    assert bad == ["", "3", "[1]", "null", "{broken"]
    got = sorted(providers.race_cards(good).collect(), key=lambda r: r.horse_name)
    assert len(got) == 3
    x, a, b = got
    assert (a.provider_race_id, a.race_time, a.racecourse, a.flat_jumps, a.distance_furlongs, a.race_class, a.number_of_runners, a.handicap_type, a.official_rating, a.draw, a.weight_lbs_total, a.non_runner, a.errors) == ("5", "14:30", "York", "JUMPS", 8.5, 2, 9, "HANDICAP", 77, 3, 130, True, [])
    assert (b.official_rating, b.sex, b.non_runner, b.errors) == (None, "f", False, ["official_rating is no int"])
    assert (x.provider_race_id, x.off, x.racecourse, x.flat_jumps, x.number_of_runners, x.horse_name, x.horse_id, x.errors) == ("x", None, "", "FLAT", 1, "", "1", ["off is no time"])
    assert providers.race_cards(good.filter("false")).count() == 0


def test_form_and_price_documents(spark):
    good, _ = rows(spark, [{"horse": "A", "date": "2024-05-01", "position": 2, "pos_3f_out": 4, "sp_decimal": "3.5"}, {"horse": "B", "date": "2024-05-03", "distance_f": "far"}, {"horse": "C"}])
    got = {r.horse_name: r for r in providers.form_entries(good).collect()}
    assert (got["A"].finishing_position, got["A"].position_3f, got["A"].starting_price, got["A"].has_positions, got["A"].errors) == (2, 4, 3.5, True, [])
    assert got["B"].errors == ["distance_furlongs is no double"] and not got["B"].has_positions and got["C"].errors == ["race_date is missing"]
    assert [r.horse_name for r in providers.form_entries(good, first="2024-05-02", last="2024-05-03").collect()] == ["B"]
    good, _ = rows(spark, [{"selection_id": 7, "market_time": "2024-05-01T10:00:00", "lay": 4, "status": "closed"}, {"market_time": "2024-05-01T11:00:00", "back": 2.5, "lay": 3}, {"selection_id": "z", "market_time": "2024-05-01T12:00:00"}])
    prices = sorted((r.tick_ts.hour, r.runner, r.price, r.is_sp) for r in providers.exchange_points(good).collect())
    assert prices == [(10, "7", 4.0, True), (11, "", 2.5, False), (12, "z", 0.0, False)]
