import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from obsframe.llm.windows import Hasher, blocks, pieces

HASHER = Hasher(5000)
TEXT = st.text(alphabet="ab é\n😀\tz", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_equal_windows_have_equal_hashes(parts):
    block = HASHER.block(parts)
    whole = " " + " ".join(parts) + " "
    for n in (2, 3, 4):
        at, hashes = block.grams(n)
        wanted = {i: whole[i:i + n].translate({9: 32, 10: 32}) for i in range(len(whole) - n + 1)
                  if not any(c.isspace() for c in whole[i + 1:i + n - 1])}
        assert set(at.tolist()) == set(wanted)
        by_text = {}
        for i, h in zip(at.tolist(), hashes.tolist()):
            assert by_text.setdefault(wanted[i], h) == h
        assert len(set(by_text.values())) == len(by_text)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_words_and_parts(parts):
    block = HASHER.block(parts)
    at, hashes = block.words()
    counted = block.per_part(at, np.ones(len(at)))
    assert counted.tolist() == [len(p.split()) for p in parts]
    words = [w for p in parts for w in p.split()]
    assert len(set(hashes.tolist())) == len(set(words)) and len(hashes) == len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 20))
def test_blocks_hold_every_character(texts, size):
    assert all("".join(pieces(t, size)) == t for t in texts)
    back = ["" for _ in texts]
    for owners, parts in blocks(texts, size):
        for owner, part in zip(owners, parts):
            back[owner] += part
    assert back == texts
