"""Byte-level BPE against tiktoken with the same ranks and pattern."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from phrasecast.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

ODD = [
    "", " ", "  ", "\n\n x", "a  b", "tabs\t\tand hard blanks 　x", "it's we'll I'd they've 'S", "naïve café Zürich",
    "日本語のテキスト", "emoji 👩‍👩‍👧 and ½ ³ ٣٤", "x" * 300, "ab" * 150, "https://example.com/a_b?c=d&e=%20", "3.14159 1e-9 0xFF", "\x00\x01\x7f\x85\x1c",
    "!!!!!!!!", "....\n....", "ǅ ʰ ﬁ ß ẞ", "Éaitreque oiaielle leelleçpa", "_" * 40, "-" * 300, "the quick brown fox",
]


def texts():
    pick = random.Random(3)
    out = list(ODD)
    letters = "abcdefghijklmnopqrstuvwxyzéèçüß"
    for _ in range(120):
        out.append(" ".join("".join(pick.choice(letters) for _ in range(pick.randrange(1, 14))) for _ in range(pick.randrange(1, 30))))
    for _ in range(120):
        out.append("".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(160, 0x250), pick.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(pick.randrange(60))))
    out.append("".join(pick.choice("abcdefgh") for _ in range(600)))
    return out


@pytest.fixture(scope="module")
def twin():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


def test_report_equals_tiktoken(spark, twin):
    rows = [(None, "no id"), (1, None), *((k + 2, t) for k, t in enumerate(texts())), (3, "a twin id"), (3, "a twin id")]
    docs = spark.createDataFrame([(a, b, "x", [1]) for a, b in rows], "doc_id bigint, text string, word string, ids array<int>").repartition(3)

    def want(doc_id, text):
        ids = twin.encode_ordinary(text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())

    got = sorted((tuple(r) for r in bpe.report(docs).collect()), key=str)
    assert got == sorted((want(a, b) for a, b in rows), key=str)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_both_folds(spark, twin, monkeypatch, limit):
    monkeypatch.setattr(bpe, "LONG", limit)
    words = [t for t in texts()[:60] if 0 < len(t) < 80] + ["a", "ab", "xx" * 30, "ÿ"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    ranks = bpe.load_ranks()
    got = [r["ids"] for r in frame.select(bpe.word_ids(F.col("w"), ranks).alias("ids")).collect()]
    assert got == [twin._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_round_trip_and_unknown_id(spark):
    ranks = bpe.load_ranks()
    frame = spark.createDataFrame([([0, 1, 50255],)], "ids array<int>")
    assert frame.select(bpe.decode(F.col("ids"), ranks)).first()[0].startswith(b"!\"")
    with pytest.raises(Exception, match="no token 60000"):
        spark.createDataFrame([([60000],)], "ids array<int>").select(bpe.decode(F.col("ids"), ranks)).collect()


def test_no_python_in_the_plan_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    out = bpe.report(docs)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("EvalPython", "MapInArrow", "MapInPandas"))
    with pytest.raises(ValueError):
        (tmp_path / "few").write_text("YQ== 0\n")
        bpe.load_ranks(str(tmp_path / "few"))
