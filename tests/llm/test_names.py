import pytest

from tidewell.llm.canonical import mapped_values
from tidewell.llm.linking import best_fit, index_codes, index_forms, query_codes, query_forms, readings
from tidewell.llm.names import damerau, lcs_ratio, parse, split_words
from tidewell.llm.variants import linked_answers, linked_to

UNIVERSE = [
    ("GDTB", "Gebrindal Waithould Software N.V.", "001"), ("GDTBW", "Gebrindal Waithould Software N.V.", "001"), ("DRMI", "Droutemoum International PLC", "002"),
    ("DRMP", "Droutemoum Petroleum Holdings Ltd.", "003"), ("TPOU", "Theodore Pouzer & Daughters Inc.", "004"), ("KLOS", "Klostabos Realty Ltd.", "005"), ("ZIED", "Zizedem & Choushun Inc.", "006"),
]
TYPED = {
    "Gebrindal Waithould Software N.V.": "001", "gebrindal  waithould sftw": "001", "GEBRIDNAL WAITHOULD SOFTWARE NV /DE/": "001", "GebrindalWaithouldSoftware": "001", "gdtb": "001", "$GDTBW": "001", "KLOS US": "005",
    "Software-Waithould-Gebrindal": "001", "Droutemoum Petrol. Hldgs": "003", "Droutemoum Intl": "002", "Droutemoum": None, "The Droutemoum (parent)": None, "Ted Pouzer + Daughters": "004", "Pouzer, T & Daughters": "004",
    "Theodore Pouzer": None, "Klóstabos Realty": "005", "Kl0stabos Realty Ltd": "005", "klostabos realty deutschland gmbh": "005", "Klostabos Realty Finance Sub II, LLC": "005", "Klostabos Realty LLP": None,
    "Klostabos Family Trust": None, "Klostabos Robotics": None, "Zizedem and Choushun": "006", "Some Other Firm Inc.": None, "unknown": None, "n/a": None, "??": None, " ": None, "": None, "x" * 50_000: None, "(KLOS)": "005",
}


def universe(spark, rows=UNIVERSE):
    return spark.createDataFrame([(*r, "clash") for r in rows] + [(None, None, None, "clash"), ("NULL", None, "009", "clash")] * bool(rows), "ticker string, name string, cik string, value string")


@pytest.mark.parametrize("rows", [1_000_000, 2])
def test_values_map_to_the_list(spark, rows):
    typed = spark.createDataFrame([(t, "clash") for t in [*TYPED, *TYPED, None]], "name string, cik string")
    got = {r["name"]: r["cik"] for r in mapped_values(typed, universe(spark), dictionary_rows=rows).collect()}
    assert {t: got.pop(t) for t in TYPED} == {t: k or "unmatched" for t, k in TYPED.items()}
    assert not got


def test_empty_lists(spark):
    typed = spark.createDataFrame([("a name",)], "name string")
    assert [tuple(r) for r in mapped_values(typed, universe(spark, [])).collect()] == [("a name", "unmatched")]
    assert mapped_values(typed.limit(0), universe(spark)).count() == 0


def test_variants_link_to_companies(spark):
    reference = universe(spark).where("name is not null").selectExpr("cik as entity", "name", "array(ticker) as tickers").groupBy("entity", "name").agg({"tickers": "collect_set"})
    reference = reference.selectExpr("entity", "name", "flatten(`collect_set(tickers)`) as tickers")
    got = {r["value"]: r["entity"] for r in linked_to(spark.createDataFrame([(t,) for t in [*TYPED, None]], "value string"), reference).collect()}
    assert got == {t: k for t, k in TYPED.items() if k}


def mapped(spark, entries, typed, **options):
    reference = spark.createDataFrame(entries, "cik string, name string, ticker string")
    rows = mapped_values(spark.createDataFrame([(t,) for t in typed], "name string"), reference, **options).collect()
    return {r["name"]: r["cik"] for r in rows}


def test_two_slips_in_a_long_word_map(spark):
    assert mapped(spark, [("1", "Gebrindalwaithouldson Software Inc", None)], ["Gebrandalwaithouldsen Software"]) == {"Gebrandalwaithouldsen Software": "1"}


@pytest.mark.parametrize("rows", [1, 100, 1_000_000])
def test_an_own_word_goes_before_an_acronym_however_the_dictionary_travels(spark, rows):
    entries = [("1", "Kelso Arden Brook Alder", None), ("2", "Kaba Energy Inc.", "KBE"), ("3", "Mond Ulf Rask Inc", "KBA"), ("4", "Zelt Foods Co", None), ("5", "Zelt Foods Inc", None), ("6", "Oak Zorn Inc", None), ("7", "Ode Zeit Inc", None)]
    want = {"Kaba": "2", "MUR": "3", "kbe": "2", "Zelt Foods": "unmatched", "Zelt Foods Co": "4", "OZI": "unmatched", "Keba Energy": "2"}
    assert mapped(spark, entries, want, dictionary_rows=rows) == want


def test_names_of_listed_or_short_words_are_met_and_fit():
    for name in ("Charles Industries Inc", "International Associates Co", "BP plc"):
        assert best_fit(name.upper(), name, [], False) and query_codes(name.upper()) & index_codes(split_words(name), [])
    assert not best_fit("Charles Industries", "Charles Industries Inc", [], False) and not best_fit("unknown", "Unknown", [], False)
    assert {f[2:] for f in query_forms("BP")} & {f[:2] for f in index_forms(["bp", "plc"])}


def test_listed_words_stay_whole_when_words_are_taken_apart():
    for typed, company in (("SusannahCrieccheglimandPartnersHoldingsLimited", "Susannah Criecheglim & Partners Holdings Ltd."), ("HejebaildResourcesplc", "Hejebaild Resources PLC"), ("BenjaminGreaacugleanandSons,Corp.", "Benjamin Greacuglean & Sons Corp")):
        own = parse(split_words(company), exact=True).stems
        assert any(name.stems and all(lcs_ratio(s, o) >= 0.8 for s, o in zip(name.stems, own)) and len(name.stems) == len(own) for name in readings(typed)[0])


def linked(spark, names, typed, **options):
    reference = spark.createDataFrame([(str(i), n, []) for i, n in enumerate(names)], "entity string, name string, tickers array<string>")
    return {r["value"]: names[int(r["entity"])] for r in linked_to(spark.createDataFrame([(t,) for t in typed], "value string"), reference, **options).collect()}


def test_a_word_that_many_names_share_links(spark):
    odd = ["Harbor Mining Inc", "Theodore Harbor Foods Inc", "Harbor & Sons Co"]
    names = odd + [f"Harbor {c}{v}zzen{d}ik Foods Inc" for c in "bcdfghklmnprstvw" for v in "aeiou" for d in "bdgklt"]
    typed = {"Harbor Mining Inc": odd[0], "harbro mining": odd[0], "Ted Harbor Foods": odd[1], "Harbor and Sons": odd[2], names[-1]: names[-1], "Harbor Energy": None}
    assert linked(spark, names, typed) == {t: n for t, n in typed.items() if n}


def test_slips_in_the_outer_letters_of_a_frequent_ending_link(spark):
    names = ["Bamoor Mining Inc", "Moorab Mining Inc"] + [n for v in "eiou" for c in "cdfghjklnpqrstvw" for n in (f"{c.upper()}{v}moor Foods Inc", f"Moor{v}{c} Foods Inc")]
    assert linked(spark, names, ["Bemoor Mining", "Moorib Mining"]) == {"Bemoor Mining": names[0], "Moorib Mining": names[1]}


def test_answers_link_to_items(spark):
    answers = spark.createDataFrame(
        [(1, "Gebrindal Waithould", ["DRMP", None, "who knows"], 9), (1, "Gebrindal Waithould", ["DRMP", None, "who knows"], 9), (2, None, None, 9), (3, "Klostabos Realty", [], 9), (4, "Droutemoum Intl", ["Outside Brothers Co"], 9)],
        "answer_id long, company_guess string, alternates array<string>, slot int")
    key = spark.createDataFrame(
        [("R1", "GEBRINDAL WAITHOULD SOFTWARE NV", "GDTB", "x"), ("R2", "Droutemoum Petrol. Holdings Ltd", None, "x"), ("R3", "Outside Brothers Co.", None, "x"), ("R4", None, None, "x")], "item string, company string, ticker string, name string")
    got = sorted(tuple(r) for r in linked_answers(answers, key, universe(spark)).collect())
    assert got == [(1, 0, "R1"), (1, 1, "R2"), (4, 1, "R3")]
    assert linked_answers(answers.limit(0), key, universe(spark)).count() == 0


def test_distances():
    assert damerau("pouzer", "pozuer") == 0.7 and damerau("kitten", "sitting") > 2 and damerau("sc3a", "scea") == 0.5
    assert lcs_ratio("abcdef", "abdcef") == pytest.approx(10 / 12) and lcs_ratio("", "x") == 0
    assert split_words("J. & K. Smith's N. V. /DE/") == ["j", "and", "k", "smiths", "nv"]


def harbors(n):
    """Names that all share the word Harbor; every second one has another own word."""
    ends = [a + b for a in "bdgklmnprstz" for b in ("alv", "ost", "ern", "ild", "ung", "ask")]
    return [f"Harbor {a.capitalize()}{b} {s} Inc" for a in ends for b in ends for s in ("Foods", "Mining", "Energy", "Medical")][:n]


def test_two_thousand_names_with_one_word_link_and_map(spark):
    names = harbors(2_000)
    slipped = {f"Harbor {n.split()[1][:2]}{n.split()[1][3:]} {n.split()[2]}": n for n in names[::10]}
    typed = [*names, *slipped, *(f"Harbor Foods {i}" for i in range(300)), "Harbor", "Harbor Foods", "Harbor Foods Inc"]
    for options in ({}, {"common": 20}):
        got = linked(spark, names, typed, **options)
        assert all(got.get(n) == n for n in names) and not {"Harbor", "Harbor Foods", "Harbor Foods Inc"} & set(got)
        assert sum(got.get(t) == n for t, n in slipped.items()) >= 0.9 * len(slipped)
    got = mapped(spark, [(str(i), n, None) for i, n in enumerate(names)], typed)
    assert all(got[n] == str(i) for i, n in enumerate(names)) and got["Harbor Foods"] == "unmatched"
    assert sum(got[t] != "unmatched" and names[int(got[t])] == n for t, n in slipped.items()) >= 0.9 * len(slipped)
