import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelcohort.llm.text import LOWER_VALUES, shingles, slices, windows

from brute import shingle_set, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b.é  ", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_shingles_and_windows_equal_plain_python(texts, limit):
    seen, grams, runs, many = {}, {}, {}, 0
    for s in slices(pa.array(texts, pa.string()), limit):
        hashes, first = s.words()
        values, at = shingles(*s.words(LOWER_VALUES), 3)
        w2, starts = windows(hashes, first, 2)
        for k in range(len(s)):
            many += 1
            text = texts[s.lo + k]
            own = words_of(text)
            assert first[k + 1] - first[k] == len(own)
            for word, h in zip(own, hashes[first[k] : first[k + 1]]):
                assert seen.setdefault(word, h) == h
            expected = shingle_set(text, 3)
            assert at[k + 1] - at[k] == len(expected)
            assert grams.setdefault(expected, tuple(values[at[k] : at[k + 1]])) == tuple(values[at[k] : at[k + 1]])
            mine = w2[(starts >= first[k]) & (starts < first[k + 1])]
            assert len(mine) == max(0, len(own) - 1)
            for pair, h in zip(zip(own, own[1:]), mine):
                assert runs.setdefault(pair, h) == h
    assert many == len(texts)
    for table in (seen, grams, runs):
        assert len(set(table.values())) == len(table)


def test_slices_keep_whole_texts():
    texts = ["x" * n for n in (5, 0, 50, 3, 3, 3)]
    got = list(slices(pa.chunked_array([texts[:2], texts[2:]]), 10))
    assert [s.text(k).decode() for s in got for k in range(len(s))] == texts
    assert max(len(s.data) for s in got) == 50
    assert list(slices(pa.array([], pa.string()))) == []
    assert np.diff(got[0].offsets).tolist() == [5, 0]
