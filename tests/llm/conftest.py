import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

TEXTS = [
    None,
    "",
    " ",
    "  two  spaces \n\n lines\r\n\ttab ",
    "It's we'll THE the, The. don't 12 345 a1b2 under_score",
    "<|endoftext|> in <|endoftext|>text<|startoftext|>",
    "é É ÀÉÎ ß ẞ İstanbul Σίσυφος ΣΑΣ é Å ﬁ ² Ⅷ 日本語テキスト 한국어 🙂👍🏽 ▁under▁ x y z\u0085w\x1cv\x00u",
    "word\nnext\n\nlast\n",
    "a" * 3000,
    "1" * 500 + " " + "-" * 500,
    "Same text twice.",
    "Same text twice.",
    "be%%% nd%%% {x: 1} <b>bold</b> http://a.b/c?d=e&f +1 (017) 555-7713 a.b@c.example.com",
]


@pytest.fixture
def docs(spark):
    rows = [(i if i != 4 else None, t, "src", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string")


@pytest.fixture
def texts():
    return TEXTS
