import random

import pytest

from siltstone.config import ChunkConfig
from siltstone.operators.chunk import chunk_rows, chunk_text

SMALL = ChunkConfig(10, 3, 2)
CASES = [
    ("short", SMALL, [(0, "short", 0, 5)]),
    ("  pad  ", SMALL, [(0, "  pad  ", 0, 7)]),
    ("x", SMALL, []),
    ("", SMALL, []),
    (None, SMALL, []),
    ("0123456789", SMALL, [(0, "0123456789", 0, 10)]),
    ("aaa bbb ccc ddd", SMALL, [(0, "aaa bbb", 0, 7), (1, "bbb ccc", 4, 7), (2, "ccc ddd", 8, 7)]),
    ("abcdefghijklmnopqrst", SMALL, [(0, "abcdefghij", 0, 10), (1, "hijklmnopq", 7, 10), (2, "opqrst", 14, 6)]),
    ("ab cdefghijklmnop", SMALL, [(0, "ab", 0, 2), (1, "cdefghijk", 2, 9), (2, "ijklmnop", 9, 8)]),
    ("0123456789 abc", SMALL, [(0, "0123456789", 0, 10), (1, "789 abc", 7, 7)]),
    ("aaaa\nbbbb\ncccc", SMALL, [(0, "aaaa\nbbbb", 0, 9), (1, "bb\ncccc", 7, 7)]),
    ("aaa bbbb ccccccc d", ChunkConfig(10, 3, 5), [(0, "aaa bbbb", 0, 8), (1, "bb ccccccc", 6, 10), (2, "ccc d", 13, 5)]),
]


@pytest.mark.parametrize(("text", "config", "expected"), CASES)
def test_hand_made_cases(text, config, expected):
    assert [tuple(c.values()) for c in chunk_text(text, config)] == expected


def test_rows_agree_with_the_function(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n😀") for _ in range(rng.randrange(0, 900))) for _ in range(60)]
    config = ChunkConfig(50, 12, 5)
    rows = chunk_rows(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", config).collect()
    expected = {(i, *c.values()) for i, t in enumerate(texts) for c in chunk_text(t, config)}
    assert {tuple(r) for r in rows} == expected


def test_words_longer_than_a_chunk_creep_to_the_end():
    found = chunk_text("ab " + "x" * 30 + " cd", ChunkConfig(10, 8, 1))
    assert found[-1]["char_offset"] + 10 >= 36 and found[-1]["text"].endswith("cd")
