"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.functions.stemming import stem
from murmur.operators import filters as fl
from murmur.operators import rolling, similarity
from murmur.sources import settings as S


@given(st.integers(1, 800), st.integers(0, 10_000))
@settings(max_examples=200, deadline=None)
def test_blocks_make_up_the_period(length, last):
    top = rolling._levels(length)
    base = last >> top << top
    days = sorted(base + x for level, node in rolling._blocks(last - base, length, top) for x in range(node << level, (node + 1) << level))
    assert days == list(range(last - length + 1, last + 1))


@given(st.dictionaries(st.sampled_from(["q", "platform", "platforms", "minLikes", "minXScore", "timeframe", "dateFrom", "dateTo", "sort", "page", "pageSize", "match", "market"]), st.text(max_size=12)))
def test_any_query_string_is_understood_or_named(query):
    f = fl.parse(query)
    assert 1 <= f.page and 1 <= f.page_size <= S.PAGE_MOST and f.sort in fl.SORTS and set(f.platforms) <= set(S.PLATFORMS)
    assert len(fl.warnings(f)) >= len(f.ignored)


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=15))
def test_a_stem_begins_like_its_word(word):
    s = stem(word)
    assert s and len(s) <= len(word) + 1
    assert len(word) <= 4 or s[:2] == word[:2]


@given(st.integers(2, 25), st.integers(0, 10_000), st.floats(0.5, 0.95))
@settings(deadline=None)
def test_groups_are_disjoint_and_as_promised(n, seed, least):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    x /= np.sqrt((x**2).sum(1))[:, None]
    s = x @ x.T
    for groups in (similarity.linked_groups(s, least), similarity.greedy_clusters(s, least, least - 0.05), similarity.star_groups(s, least)):
        flat = [v for g in groups for v in g]
        assert len(flat) == len(set(flat)) and all(len(g) >= 2 for g in groups)
    linked = similarity.linked_groups(s, least)
    assert all(max(s[v, w] for w in g if w != v) >= least for g in linked for v in g)
    assert all(s[g[0], v] >= least for g in similarity.star_groups(s, least) for v in g[1:])
