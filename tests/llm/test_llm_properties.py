"""Properties on random input."""

import os
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from sedgeline.llm import bags, bpe, neardup, overlap, sentences, targets  # noqa: E402
from sedgeline.llm.queries import VOCABULARY  # noqa: E402

PIECES = st.lists(st.sampled_from(["Dr.", "Hair", "oil", "it's", "3.5", "...", "…", "!", "?", "“", "”", '"', "(", ")", "\n", "\n\n", " ", " ", "- ", "2. ", "<p>", "</p>", "<br/>", "香り", "。", "「", "」", "ผม ดี", "है।", "Q:", "👍", "​", "a.b/c?d=1", "«", "»", "😀", "É", "."]), max_size=40).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_sentences_cover_what_is_visible(text):
    own = sentences.Splitter(sentences.Model())
    spans = own.split(text, "en")
    s = sentences.blank_tags(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(s) if not sentences.blank(c))


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_encoder_equals_library_on_random_text():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    with open(VOCABULARY, encoding="utf-8") as f:
        own = bpe.PairIndex(f.read())

    @given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
    @settings(max_examples=300, deadline=None)
    def check(texts):
        assert own.encode(texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]

    check()


WORDS = st.lists(st.sampled_from(list("abcdefgh")), min_size=1, max_size=60)


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_bags_and_bounds(a, b):
    both, lens = bags.elements([sorted(a), sorted(b)], {})
    x, y = both[: len(a)], both[len(a) :]
    shared = (Counter(a) & Counter(b)).total()
    assert bags.common(" ".join(a), " ".join(b)) == shared == len(set(x.tolist()) & set(y.tolist()))
    segs = bags.popcounts(both, lens)
    far = int(bags.apart(segs[:1], segs[1:])[0])
    assert far <= len(a) + len(b) - 2 * shared
    # alike texts meet in the elements that they show, whatever the similarity, for both operators
    count = np.zeros(bags.BUCKETS, np.int64)
    for t in (0.5, 0.7, 0.9):
        if shared >= t * (len(a) + len(b) - shared):
            least = max(1, min(bags.LEAST, int(np.ceil(t * max(len(a), len(b)) - 1e-9))))
            for first in (neardup.first_cells, overlap.first_part):
                show = bags.rarest(both, lens, count, np.array([first(lens[:1], len(b), t, least)[0], first(lens[1:], len(a), t, least)[0]]))
                assert len(set(show[0].tolist()) & set(show[1].tolist())) >= least
                assert first(np.array([len(x)]), 0.0, t, bags.LEAST)[0] >= min(len(x), len(show[0]))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5), st.lists(st.integers(0, 12), min_size=1, max_size=4)), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_flow_meets_demand_or_names_the_shortfall(categories):
    wants, cells = [], []
    for k, (demand, floor, sizes) in enumerate(categories):
        demand = max(demand, floor)
        wants.append((f"c{k}", demand, floor, sum(sizes)))
        cells += [([f"c{k}"], f"c{k}-{i}", n) for i, n in enumerate(sizes)]
    report, quotas = targets.solve("n", wants, cells, "salt")
    size = {key: n for _, key, n in cells}
    assert all(0 <= q["quota"] <= size[q["key"]] for q in quotas)
    for (name, demand, floor, records), r in zip(wants, report):
        assert r["allotted"] == min(demand, records)
        assert r["floor_short"] + r["margin_short"] == max(0, demand - records)
        assert r["floor_short"] == max(0, min(floor, demand) - records)
        share = [(q["quota"], min(demand, records) * size[q["key"]] / records if records else 0) for q in quotas if q["category"] == name]
        assert all(abs(q - s) < 1 + 1e-9 for q, s in share)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4)), min_size=1, max_size=4), st.lists(st.tuples(st.sets(st.integers(0, 3), min_size=1, max_size=3), st.integers(1, 9)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_records_in_several_cells_are_drawn_once(asked, held):
    """Drawn and short add up to the demand of every category, and no cell gives more records than it has."""
    names = [f"c{k}" for k in range(len(asked))]
    cells = [([names[c] for c in sorted(own) if c < len(names)], f"x{i}", n) for i, (own, n) in enumerate(held)]
    cells = [c for c in cells if c[0]]
    wants = [(name, max(d, f), f, sum(n for own, _, n in cells if name in own)) for name, (d, f) in zip(names, asked)]
    report, quotas = targets.solve("n", wants, cells, "salt")
    for (_, demand, _, records), r in zip(wants, report):
        assert r["allotted"] + r["floor_short"] + r["margin_short"] == demand
        assert r["allotted"] <= records
        assert records >= demand or r["floor_short"] + r["margin_short"] > 0
    for _, key, n in cells:
        assert sum(q["quota"] for q in quotas if q["key"] == key) <= n
    cuts = []  # as many as can be drawn: the least cut, by all sets of categories on the side of the records
    for k in range(1 << len(names)):
        out = {n for i, n in enumerate(names) if k >> i & 1}
        cuts.append(sum(w[1] for w in wants if w[0] not in out) + sum(n for own, _, n in cells if out & set(own)))
    assert sum(r["allotted"] for r in report) == min(cuts)
