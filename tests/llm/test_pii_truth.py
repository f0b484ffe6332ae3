"""Spans that the model adds, against truth written by hand, and its choice against a plain one."""

from __future__ import annotations

import numpy as np
import pytest

from loomgraph.llm import pii

#: Lines with the added spans in <kind:...>; none is printed by the module's own examples.
LINES = """
Please write to <email:maria.lopez [at] uni-bremen [dot] de> before Friday
my address is <email:j_doe(at)mail.example.org>, thanks
reach us: <email:info {at} shop {dot} co {dot} uk>
contact <email:press [at] news-desk.com> for details
the meeting is at [room 4] near the gate
he looked (at noon) and left
Call me on <phone:(415) 555-2671> after six
phone <phone:030 555 1234> or come by
tel. <phone:212-555-0187>, ask for Ms Gray
fax: <phone:(0170) 555 9921>
dial <phone:0049 171 555-1234> from abroad
the score was 212-14 and 30-20
version 10.4.2-beta3 of 2021-05-06
order 4471-2290-11 was shipped in 3 boxes
on 12.05.2021 and 13.05.2021 we met
invoice 2020/0001-0002 is open
my visa is <card:4539 1488 0343 6468> exp 12/27
paid with card <card:5500-0000-0000-0005> yesterday
credit card <card:6011000990139425> on file
isbn 9780306406158x is out of print
sha 1234567890123456789 of the commit
serial-20210506123456 is the batch
host <ip:2001:0db8:85a3:0000:0000:8a2e:0370:7334> is down
from <ip:fe80:0000:0000:0000:0204:61ff:fe9d:f156> to the router
time 10:20:30:40 in the log
hash 12:34:56:78:90:12:34:56 matches
"""


def truth():
    out = []
    for line in LINES.strip().split("\n"):
        text, spans, rest = "", [], line
        while "<" in rest:
            before, _, rest = rest.partition("<")
            inside, _, rest = rest.partition(">")
            kind, _, body = inside.partition(":")
            text += before
            spans.append((kind, len(text), len(text) + len(body)))
            text += body
        out.append((text + rest, spans))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.Model.fit()


def test_generators_find_nearly_every_span():
    found = total = 0
    for text, spans in truth():
        base, doubtful = pii.base_spans(text)
        have = set(base) | set(pii.candidates(text, doubtful))
        found += sum(s in have for s in spans)
        total += len(spans)
    assert total >= 14 and found / total >= 0.95


def test_chosen_spans_are_right(model):
    texts = [t for t, _ in truth()]
    want = {(i, s) for i, (_, spans) in enumerate(truth()) for s in spans}
    got = {(i, s) for i, (_, spans) in enumerate(model.select(texts)) for s in spans}
    right = len(want & got)
    assert right / len(want) >= 0.85, sorted(want - got)  # recall
    assert right / len(got) >= 0.85, sorted(got - want)  # precision


def test_the_choice_equals_a_plain_one(model):
    """Best first, nothing that overlaps: against repeated searches for the best span left."""
    rng = np.random.default_rng(0)
    pieces = ["4111 1111 1111 1111", "9807915762804490", "(415) 555-2671", "212-555-0187 3434", "a [at] b [dot] c [dot] d", "x", "call", "card", "10.0.0.1", "+1 212 555 0187", "1:2:3:4:5:6:7:8:9"]
    for _ in range(300):
        text = " ".join(rng.choice(pieces, rng.integers(1, 9)))
        base, doubtful = pii.base_spans(text)
        left = pii.candidates(text, doubtful)
        chance = dict(zip(left, model.trees.chance(np.array([pii.features(text, c) for c in left])).tolist(), strict=True)) if left else {}
        taken, left = list(base), [c for c in left if chance[c] >= model.thresholds[c[0]]]
        while left:
            best = min(left, key=lambda c: (-chance[c], c))
            taken.append(best)
            left = [c for c in left if c[2] <= best[1] or best[2] <= c[1]]
            left = [c for c in left if all(c[2] <= s or e <= c[1] for _, s, e in taken)]
        free = [c for c in taken[len(base):] if all(c[2] <= s or e <= c[1] for _, s, e in base)]
        ((_, chosen),) = model.select([text])
        assert set(chosen) == set(base) | set(free), text


def test_held_out_examples(model):
    """Precision and recall on printed examples of another seed."""
    x, y, kinds = pii._examples(1500, seed=99)
    keep = model.trees.chance(x) >= np.array([model.thresholds[k] for k in kinds])
    assert (keep & (y == 1)).sum() / keep.sum() >= 0.97 and (keep & (y == 1)).sum() / (y == 1).sum() >= 0.8
