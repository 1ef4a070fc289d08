import random
import re

import pytest
from pyspark.sql import functions as F

from phrasecast.functions import phrases as ph
from phrasecast.operators import label

MATCHES = [
    ("Ferry", "Two ferries left at dawn", True),
    ("Ferry", "We heard the ferry's horn", True),
    ("Ferry", "A ferryman waved", False),
    ("lamp", "One lamp stood by the gate", True),
    ("lamp", "Lamplight fell on the wall", False),
    ("Salt and pepper", "He passed salts and pepper", True),
    ("Salt and pepper", "A salt-and-pepper beard", True),
    ("Salt and pepper", "salt – and — pepper", True),
    ("Violin", "Both violins’ strings broke", True),
    ("May 9", "Rent is due on May 9th.", True),
    ("May 9", "Room May 93 is locked", False),
    ("NET", "The fisher mends a net", True),
    ("Orla / Quist", "Orla Street is closed", True),
    ("Orla / Quist", "Then Quist left", True),
    ("Orla / Quist", "Orlando is far away", False),
    ("box", "ébox", False),
    ("box", "boxes", True),
    ("shelf", "shelves' shelf", True),
    ("F#", "tune it to f# now", True),
    ("F#", "tune it to f## now", True),
]


@pytest.mark.parametrize("term,text,expected", MATCHES)
def test_pattern(spark, term, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(ph.Phrase.of(term).hit(F.col("text"), prefilter=False)).first()[0] is expected


def test_prefilter_is_part_of_the_label(spark):
    df = spark.createDataFrame([("Old cities.",), ("Old city's.",)], "text string")
    phrase = ph.Phrase.of("city")
    got = df.select(phrase.hit(F.col("text")), phrase.hit(F.col("text"), False)).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True)]


def test_counts_do_not_overlap(spark):
    text = "Rainfall charts follow\nFarmers track rainfall and rainfall-fed wells. érainfall"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(ph.Phrase.of("rainfall").count(F.col("text"))).first()[0] == 3


def test_random_texts_match_python_rules(spark):
    terms = ["ferry", "salt and pepper", "QE", "Orla / Quist Fund", "May 9", "co-op", "hero", "crisis"]
    rng = random.Random(2)
    bits = [
        "ferry", "Ferries", "ferry's", "salt", "Salts", "and", "pepper", "peppers’", "QE", "qes", "Orla", "orlas", "quist", "funds",
        "May", "9", "9th", "93", "co-op", "heroes", "hero'", "crises", "crisis'", " ", " ", " ", "-", "–", "_", "é", ".", "\n",
        "\xa0", "\u2003", "²", "\u0301", "'s", "’",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    phrases = ph.vocabulary(terms)
    got = df.select("i", *[p.count(F.col("text")).alias(p.column) for p in phrases]).orderBy("i").collect()

    def word(w):
        return r"\d+(?:st|nd|rd|th)?".replace(r"\d+", w) if w.isdigit() else (
            "(?:" + "|".join(sorted(map(re.escape, ph.word_forms(w)), key=len, reverse=True)) + ")" if w.isalpha() else re.escape(w)
        )

    for p in phrases:
        parts = [r"(?:\s+|\s*[-‐‑–—]\s*)".join(word(w) for w in alt.split()) for alt in p.term.split("/")]
        rule = re.compile("|".join(rf"(?<!\w){x}(?!\w)" for x in parts), re.I)
        wrong = [(t, r[p.column]) for t, r in zip(texts, got) if r[p.column] != len(rule.findall(t))]
        assert not wrong, (p.term, wrong[:3])


def test_blank_term(spark):
    phrase = ph.Phrase.of("  ")
    df = spark.createDataFrame([("a  b    c",)], "text string")
    assert phrase.pattern is None and phrase.column == "target__term"
    assert tuple(df.select(phrase.hit(F.col("text")), phrase.count(F.col("text"))).first()) == (True, 3)


def test_slugs(spark):
    assert ph.target_slug("Orla / Quist") == "target__orla_quist"
    assert ph.target_slug("--") == "target__term"
    with pytest.raises(ValueError):
        ph.vocabulary(["balance sheet", "Balance-Sheet"])
    df = spark.createDataFrame([("Orla / Quist",), ("--",)], "t string")
    assert [r[0] for r in df.select(ph.slug_column(F.col("t"))).collect()] == ["target__orla_quist", "target__term"]


def test_humanise(spark):
    df = spark.createDataFrame(
        [("target__of_the", "of the"), ("target__of_the", None), (None, None), ("plain_x", "")], "c string, l string"
    )
    got = [r[0] for r in df.select(ph.humanise_slug(F.col("c"), F.col("l"))).collect()]
    assert got == ["of the", "of the", "Tracked phrase", "plain x"]


@pytest.mark.parametrize(
    "speaker,include,exclude,expected",
    [
        ("CHAIR VANTORP", ["vantorp"], [], True),
        ("REPORTER", ["vantorp"], [], False),
        ("HARBOUR NEWS REPORTER", [], ["reporter"], False),
        ("CHAIR VANTORP", ["vantorp"], ["chair"], False),
        (None, ["vantorp"], [], False),
        (None, [], ["vantorp"], True),
        ("  ", [], [], True),
        ("CHAIR-VANTORP", ["chair vantorp"], [], True),
        ("CHAIR VANTORPS", ["chair vantorp"], [], False),
        ("CHAIR VANTORP.", ["CHAIR VANTORP."], [], False),
        ("ABC1", ["regex: ^abc\\d$"], [], True),
        ("ANYONE", ["", " "], None, True),
    ],
)
def test_speaker_filter(spark, speaker, include, exclude, expected):
    df = spark.createDataFrame([(speaker,)], "speaker string")
    assert df.select(ph.speaker_allowed(F.col("speaker"), include, exclude)).first()[0] is expected


def test_empty_regex_term():
    with pytest.raises(ValueError):
        ph.speaker_pattern("regex: ")


SEGMENTS = [
    ("EVT1", "EVT1_S0001", "Tide tables first", "CHAIR VANTORP", 0, 17),
    ("EVT1", "EVT1_S0002", "So noted, Chair Vantorp", "REPORTER", 18, 40),
]
SEGMENT_TYPE = "event_id string, segment_id string, text string, speaker string, start_char int, end_char int"


def test_build_rows_and_validation(spark):
    inventory = spark.createDataFrame(
        [("EVT1", "press", "2024-01-31", "u", None, "x"), ("EVT2", "press", "2024-02-01", None, None, "y")],
        "event_id string, event_type string, event_date string, source_url string, provenance string, desk string",
    ).withColumn("event_date", F.col("event_date").cast("date"))
    segments = spark.createDataFrame(SEGMENTS, SEGMENT_TYPE)
    rows = label.build_rows(segments, inventory, ["tide"], include=["vantorp"])
    assert rows.columns == label.SEGMENT_COLUMNS + ["desk", "target__tide"]
    got = rows.collect()
    assert len(got) == 1 and got[0]["target__tide"] is True and got[0]["event_type"] == "press"
    with pytest.raises(ValueError):
        label.attach_inventory(segments, inventory.withColumn("speaker", F.lit("x")))


def test_validation(spark):
    rows = spark.createDataFrame(SEGMENTS, SEGMENT_TYPE)
    good = label.validate_segments(rows).first()
    assert good["checks"] == {"unique_segment_ids": True, "non_empty_text": True} and good["notes"] == []
    bad = label.validate_segments(rows.unionByName(rows.withColumn("text", F.lit(" \n")))).first()
    assert bad["checks"] == {"unique_segment_ids": False, "non_empty_text": False}
    none = label.validate_segments(rows.filter("false")).first()
    assert none["checks"] == {"non_empty": False} and len(none["notes"]) == 1


def test_target_table(spark):
    rows = label.target_table(spark, ["Orla / Quist"]).collect()
    assert rows[0]["column"] == "target__orla_quist" and rows[0]["first_words"] == ["orla", "quist"]
