"""Sequences of many short texts carry no padding before the last ones either."""

from surtscope.llm import packing


def test_short_texts_are_cut_to_powers_of_two():
    packer, pieces = packing.VectorPacker(pool=256), []
    for item in range(1000):
        pieces += packer.add(item, 5, 5)
    pieces += packer.finish()
    totals, segments = {}, {}
    for p in pieces:
        totals[p.sequence] = totals.get(p.sequence, 0) + p.length
        segments[p.sequence] = segments.get(p.sequence, 0) + 1
    assert sum(totals.values()) == 5000 and max(segments.values()) <= 64
    assert all(n & (n - 1) == 0 for n in totals.values())
