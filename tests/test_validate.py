"""Validation rules and JSON sources (A1, A2, V1-V15) on the behaviour cases."""

import json

from mediascore.operators.validate import (
    accept_envelopes,
    envelope_rejections,
    reject_failed_batches,
    validate,
    validate_report,
    validate_split_quarantine,
    validate_split_valid,
)
from mediascore.sources.records import envelope_items, scan_batch_envelope, scan_json_records

FULL = {
    "imdb_id": "tt7654321", "release_year": 1987, "budget": 310500, "revenue": 74, "runtime": 63,
    "origin_country": ["NO", "DK"], "production_companies": ["Fjord og Sund", "Kystlag 9"], "production_countries": ["DK"],
    "production_status": "In Review", "original_language": "da", "spoken_languages": ["da", "no"],
    "genre": ["Sea Tales"], "tagline": "Rain all week", "overview": "Two ferries and one pier.",
    "tmdb_rating": 3.125, "tmdb_votes": 41, "rt_score": 17, "metascore": 8, "imdb_rating": 0.4,
    "imdb_votes": 1203,
}


def _errors(spark, docs):
    lines = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "i int, value string")
    v = validate(scan_json_records(lines))
    return {r["i"]: r["errors"] for r in v.select("i", "errors").collect()}


def test_full_and_minimal_records_are_valid(spark):
    got = _errors(spark, [FULL, {"imdb_id": "tt7654321"}, {**FULL, "title": "x", "year": 1, "rating": 2}])
    assert got == {0: [], 1: [], 2: []}


def test_contract_rejections(spark):
    docs = [
        {**FULL, "imdb_id": "invalid_id"},
        {**FULL, "release_year": 1800},
        {**FULL, "tmdb_rating": 15.0},
        {**FULL, "budget": -1000000},
        {**FULL, "origin_country": ["USA"]},
        {**FULL, "original_language": "eng"},
        {**FULL, "genre": ["x" * 45]},
        "invalid json",
        '{"rating": }',
    ]
    got = _errors(spark, docs)
    assert got[0] == ["imdb_id:pattern"]
    assert got[1] == ["release_year:range"]
    assert got[2] == ["tmdb_rating:range"]
    assert got[3] == ["budget:range"]
    assert got[4] == ["origin_country:element_length"]
    assert got[5] == ["original_language:max_length", "original_language:length"]
    assert got[6] == ["genre:element_length"]
    assert got[7] == ["record:malformed_json"]
    assert got[8] == ["record:malformed_json"]


def test_lax_typing_and_edge_cases(spark):
    docs = [
        {**FULL, "imdb_id": "tt7654321\n"},
        {**FULL, "release_year": "1987"},
        {**FULL, "release_year": 1987.0},
        {**FULL, "release_year": "1987.0"},
        {**FULL, "release_year": 1987.5},
        '{"imdb_id": "tt7654321", "tmdb_rating": 8.7000}',
        '{"imdb_id": "tt7654321", "tmdb_rating": 8.7004}',
        '{"imdb_id": "tt7654321", "imdb_rating": 92.00}',
        '{"imdb_id": "tt7654321", "imdb_rating": 92.05}',
        {**FULL, "genre": ["a", None]},
        {**FULL, "genre": []},
        {**FULL, "original_language": "é😀"},
        {**FULL, "release_year": ""},
        {**FULL, "tmdb_rating": "NaN"},
        '{"imdb_id": "tt7654321", "tmdb_rating": "8.70000000000000000001"}',
        {"imdb_id": None},
    ]
    got = _errors(spark, docs)
    assert got[0] == ["imdb_id:pattern"]
    assert got[1] == got[2] == got[3] == []
    assert got[4] == ["release_year:type"]
    assert got[5] == []
    assert got[6] == ["tmdb_rating:scale"]
    assert got[7] == []
    assert got[8] == ["imdb_rating:scale"]
    assert got[9] == ["genre:null_element"]
    assert got[10] == []
    assert got[11] == []
    assert got[12] == ["release_year:type"]
    assert got[13] == ["tmdb_rating:type"]
    assert got[14] == ["tmdb_rating:scale"]
    assert got[15] == ["imdb_id:required"]


def test_strict_json_types(spark):
    docs = [
        {**FULL, "tagline": {"x": 1}},
        {**FULL, "production_status": ["x"]},
        {**FULL, "original_language": 12},
        {**FULL, "genre": [1, 2]},
        {**FULL, "genre": "Drama"},
        {**FULL, "spoken_languages": [["da"]]},
        {**FULL, "release_year": "true"},
        {**FULL, "rt_score": True},
        {**FULL, "imdb_rating": True},
        json.dumps(FULL) + " trailing",
        json.dumps(FULL) + "," + json.dumps(FULL),
        '{"imdb_id": "tt7654321", "tmdb_rating": 8.70000000000000000001}',
        '{"imdb_id": "bad", "imdb_id": "tt7654321"}',
        "null",
        "",
    ]
    got = _errors(spark, docs)
    assert [got[i] for i in range(len(docs))] == [
        ["tagline:type"], ["production_status:type"], ["original_language:type"], ["genre:element_type"], ["genre:type"],
        ["spoken_languages:element_type"], ["release_year:type"], [], ["imdb_rating:type"], ["record:malformed_json"],
        ["record:malformed_json"], ["tmdb_rating:scale"], [], ["record:malformed_json"], ["record:malformed_json"],
    ]


def test_what_follows_a_record_is_seen(spark):
    """A closing bracket in the text does not hide what comes after it."""
    full = json.dumps(FULL)
    docs = [full + "]junk", full + '] {"imdb_id":"tt1234567"}', full + "]", full + ",1]", full + " , 5", full + "\n  ", full + '],"x"]', "[" + full + "]"]
    got = _errors(spark, docs)
    bad = ["record:malformed_json"]
    assert [got[i] for i in range(len(docs))] == [bad, bad, bad, bad, bad, [], bad, bad]


def test_numbers_as_text(spark):
    """The integer and decimal forms of the contract's typing, and JSON numbers with an exponent."""
    ints = {"1994": True, "1994.0": True, "1994.": False, "1994.5": False, "1_994": True, "19__94": False, "_1994": False, "1994_": False, "+1994": True, " 1994 ": True,
            "1994\u001c": False, "\u00a01994": True, "1e3": False, ".0": False, "01994": True, "1_99_4.00": True, "1994.0_0": False, "٣": False}
    decimals = {"8.5": True, "8.": True, ".5": True, "85e-1": True, "8_.5": True, "+8": True, "1e": False, "nan": False, "": False, "_": False, "0x8": False, "\u001c8": True}
    docs = [{"imdb_id": "tt7654321", "release_year": t} for t in ints] + [{"imdb_id": "tt7654321", "tmdb_rating": t} for t in decimals]
    got = _errors(spark, docs)
    for i, (t, ok) in enumerate(ints.items()):
        assert ("release_year:type" not in got[i]) == ok, t
    for i, (t, ok) in enumerate(decimals.items(), len(ints)):
        assert ("tmdb_rating:type" not in got[i]) == ok, t
    numbers = ['{"imdb_id": "tt7654321", "budget": 1e7, "release_year": 1.994e3, "tmdb_rating": 85e-1}', '{"imdb_id": "tt7654321", "budget": 1e400}', '{"imdb_id": "tt7654321", "budget": 1.5e0}']
    assert _errors(spark, numbers) == {0: [], 1: ["record:malformed_json"], 2: ["budget:type"]} or _errors(spark, numbers) == {0: [], 1: ["budget:type"], 2: ["budget:type"]}


def test_every_rule_is_broken_by_the_fixture(spark):
    from mediascore.schema import MALFORMED_RULE, RULE_NAMES
    from mediascore.sources.fixtures import media_raw

    v = validate(scan_json_records(media_raw(spark, "/root/testdata/sf0.01")))
    assert {r["rule"] for r in validate_report(v).collect()} == {*RULE_NAMES, MALFORMED_RULE}


def test_typed_values_and_splits(spark):
    lines = spark.createDataFrame([(json.dumps(FULL),), (json.dumps({**FULL, "release_year": "1987"}),), (json.dumps({**FULL, "rt_score": 101}),)], "value string")
    v = validate(scan_json_records(lines))
    good = validate_split_valid(v).collect()
    assert len(good) == 2 and {r["release_year"] for r in good} == {1987}
    assert str(good[0]["tmdb_rating"]) == "3.125"
    bad = validate_split_quarantine(v).collect()
    assert [r["errors"] for r in bad] == [["rt_score:range"]]
    assert {r["rule"]: r["n_rows"] for r in validate_report(v).collect()} == {"rt_score:range": 1}


def test_envelopes(spark):
    ok = json.dumps({"items": [FULL, {**FULL, "imdb_id": "tt12345678"}]})
    one_bad = json.dumps({"items": [FULL, {**FULL, "imdb_id": "invalid_id"}]})
    empty = json.dumps({"items": []})
    bare = json.dumps([FULL])
    env = spark.createDataFrame([(1, ok), (2, one_bad), (3, empty), (4, bare), (5, "{")], "request_id long, value string")
    parsed = scan_batch_envelope(env)
    flags = {r["request_id"]: r["items"] is not None for r in parsed.collect()}
    assert flags == {1: True, 2: True, 3: True, 4: False, 5: False}
    accepted = envelope_items(accept_envelopes(parsed)).orderBy("request_id", "pos").collect()
    assert [(r["request_id"], r["pos"], r["imdb_id"]) for r in accepted] == [(1, 0, "tt7654321"), (1, 1, "tt12345678")]
    assert accepted[0]["release_year"] == 1987
    rows = envelope_items(accept_envelopes(parsed), outer=True).collect()
    assert [(r["pos"], r["imdb_id"]) for r in rows if r["request_id"] == 3] == [(None, None)]
    why = sorted((r["request_id"], r["pos"], r["rule"]) for r in envelope_rejections(parsed).collect())
    assert why == [(2, 1, "imdb_id:pattern"), (4, None, "envelope:malformed"), (5, None, "envelope:malformed")]
    for df in (envelope_items(accept_envelopes(parsed)), envelope_rejections(parsed)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_envelopes_that_share_an_id_or_go_on(spark):
    from mediascore.plans.predict import results_envelope
    from pyspark.sql import functions as F

    two = [json.dumps({"items": [{**FULL, "imdb_id": f"tt000000{i}"} for i in own]}) for own in ([1, 2], [3])]
    env = spark.createDataFrame([(1, two[0]), (1, two[1]), (2, '{"items":[]}]junk'), (3, two[0] + "]"), (4, '{"items":[]}')], "request_id long, value string")
    items = envelope_items(accept_envelopes(scan_batch_envelope(env)), outer=True)
    scored = items.withColumn("prediction", F.lit(True)).withColumn("probability", F.lit(0.75))
    got = sorted((r["request_id"], [x["imdb_id"] for x in r["results"]]) for r in results_envelope(scored).collect())
    assert got == [(1, ["tt0000001", "tt0000002"]), (1, ["tt0000003"]), (4, [])]


def test_flat_batches_all_or_nothing(spark):
    rows = [(1, json.dumps(FULL)), (1, json.dumps({**FULL, "budget": -1})), (2, json.dumps(FULL))]
    v = validate(scan_json_records(spark.createDataFrame(rows, "request_id long, value string")))
    kept = reject_failed_batches(v).collect()
    assert [r["request_id"] for r in kept] == [2]
    rows = [(None, json.dumps({**FULL, "budget": -1})), (None, json.dumps(FULL)), (2, json.dumps(FULL))]
    v = validate(scan_json_records(spark.createDataFrame(rows, "request_id long, value string")))
    assert [r["request_id"] for r in reject_failed_batches(v).collect()] == [2]
