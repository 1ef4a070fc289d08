"""Benchmark items that are short, full of numbers, or asked again with other names and numbers."""

from phrasecast.llm import decontaminate

from .conftest import prose

A, B = " ".join(prose(31, 40)), " ".join(prose(32, 40))
COPY = " ".join(prose(33, 20)) + " costs 12 dollars in June and " + " ".join(prose(34, 12)) + " sold for 12 dollars again " + " ".join(prose(35, 20))
TWO = "the farmer counts 5 cows and also 3 goats before he walks home along the river in the evening"
TOM = "Tom has 5 apples. Tom gives 2 to Ann. How many apples does Tom have?"


def pairs(spark, make_docs, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make_docs([(i, t, "en", "a") for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}


def test_short_items(spark, make_docs):
    items = ["What is the capital of France?", "日本の首都はどこですか。", "Compute 12 + 7 * 3 - 4.", "What is 15 percent of 80?"]
    texts = [f"{A}. {t} {B}" for t in items] + [f"{A}东京日本の首都はどこですか？{B}"] + items
    near = ["Compute 12 + 7 * 3 - 5.", "What is 15 percent of 90?", "What is the capital of it?", f"{A} {B}"]
    got = pairs(spark, make_docs, items, texts + near)
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 1), (5, 0), (6, 1), (7, 2), (8, 3)}


def test_asked_again(spark, make_docs):
    texts = [
        TOM.replace("Tom", "Bob").replace("5", "7").replace("2", "3").replace("Ann", "Eve"),
        f"{A} {COPY.replace('12', '17', 1)} {B}",
        f"{A} {TWO.replace('5', '4').replace('3', '4')} {B}",
        f"{A} {B}", "Bob has many friends. How many of them does Eve know?",
    ]
    assert pairs(spark, make_docs, [TOM, COPY, TWO], texts) == {(0, 0), (1, 1), (2, 2)}
