import pytest

from sediment.llm import pii

GIVEN = [("Adalric", "Ric"), ("Theodora", "Teddy"), ("Benedetto", "Ben"), ("Katharina", None), (None, None)]
CASES = [
    ("Ask Theodora Quillan about it.", [("NAME", "Theodora Quillan")]),
    ("Signed by QUILLAN, Theodora, 29b Juniper Drive, Eskhaven, tel. 212-555-0115", [("NAME", "QUILLAN, Theodora"), ("ADDRESS", "29b Juniper Drive"), ("PHONE", "212-555-0115")]),
    ("Dr. T. Quillan, Mühlenring 148, 35651 Talbrück", [("NAME", "T. Quillan"), ("ADDRESS", "Mühlenring 148")]),
    ("Frau theodora quillan ist unter +49 (0)30 23125 039 erreichbar.", [("NAME", "theodora quillan"), ("PHONE", "+49 (0)30 23125 039")]),
    ("write to ada.b+x@example.org or ada (at) mail (dot) example now", [("EMAIL", "ada.b+x@example.org"), ("EMAIL", "ada (at) mail (dot) example")]),
    ("cc: ada at example dot com; B @ example.net", [("EMAIL", "ada at example dot com"), ("EMAIL", "B @ example.net")]),
    ("ssn:000-08-4365 and QQ 24 43 96 B, passport says C07903906", [("ID_NUMBER", "000-08-4365"), ("ID_NUMBER", "QQ 24 43 96 B"), ("ID_NUMBER", "C07903906")]),
    ("part no. 489.505.3059, order 581-8810683, host 10.0.6.1 at 14:30 on 2024-03-18", []),
    ("My number is 646.555.0156, invoice 9014-61-8392B", [("PHONE", "646.555.0156")]),
    ("14 rue des Tilleuls, 16955 Talbrück", [("ADDRESS", "14 rue des Tilleuls")]),
    ("Thanks Teddy! The team in Kornstraße met Silver Falcon in Port Amary.", []),
    ("Theodora Quillan Notaries and Adalric Energy GmbH sent it", []),
    ("Understood, Ben. the plan is due", []),
    ("theodora.quillan@example.org", [("EMAIL", "theodora.quillan@example.org")]),
    ("🙂 é Katharina T. O'Merrow", [("NAME", "Katharina T. O'Merrow")]),
]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder([a for a, _ in GIVEN if a], [b for _, b in GIVEN if b])


@pytest.mark.parametrize(("text", "want"), CASES)
def test_spans(finder, text, want):
    assert [(s.kind, text[s.start : s.end]) for s in finder.find(text)] == want


def test_mask_keeps_the_rest(finder):
    text = "A  b\nTheodora Quillan, tel. 212-555-0115.\n"
    assert finder.mask(text) == "A  b\n<NAME>, tel. <PHONE>.\n"
    assert finder.mask(None) is None and finder.mask("") == ""


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.spanish("X1234567L") and not pii.spanish("X1234567M")


def test_frames(spark, finder):
    long = "x " * 300_000 + "Theodora Quillan"
    rows = [("c", "1", CASES[0][0], 9), ("c", "2", None, 9), ("c", "3", "", 9), ("c", "4", long, 9), ("c", "1", CASES[0][0], 9), (None, None, CASES[0][0], 9)]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string, start_pos int")
    names = spark.createDataFrame(GIVEN, "full_name string, short_name string")
    got = sorted((r.rec_id or "", r.pii_type, r.start_pos) for r in pii.find_pii(df, names).collect())
    assert got == [("", "NAME", 4), ("1", "NAME", 4), ("1", "NAME", 4), ("4", "NAME", 600_000)]
    masked = {r.rec_id: r.text for r in pii.mask_pii(df, names).collect()}
    assert masked["2"] is None and masked["3"] == "" and masked["1"] == "Ask <NAME> about it." and masked["4"].endswith("<NAME>")
    assert pii.find_pii(df.limit(0), names).count() == 0 and pii.find_pii(df, names.limit(0)).count() == 0
