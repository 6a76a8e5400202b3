import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revquarry.operators import delta


@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 300), st.binary(max_size=20)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_round_trip(base, edits):
    target = bytearray(base)
    for at, new in edits:
        target[at : at + 3] = new
    assert delta.apply_delta(base, delta.make_delta(base, bytes(target))) == bytes(target)


def test_small_for_small_edits():
    rng = random.Random(12345)
    base = bytes((i % 100) + (i // 100) % 10 for i in range(200_000))
    target = bytearray(base)
    for _ in range(20):
        target[rng.randrange(len(base))] ^= 1
    made = delta.make_delta(base, bytes(target))
    assert delta.apply_delta(base, made) == bytes(target) and len(made) < len(base) // 10


@pytest.mark.parametrize(("n", "raw"), [(1, "01"), (127, "7f"), (128, "8000"), (255, "807f"), (256, "8100")])
def test_offsets(n, raw):
    assert delta.offset_number(n).hex() == raw
    assert delta.read_offset(bytes.fromhex(raw), 0) == (n, len(raw) // 2)


def test_bad_deltas():
    base = b"x" * 40
    good = delta.make_delta(base, base + b"y")
    for bad, said in ((good[:2] + b"\0", "reserved"), (delta.size_number(41) + good[1:], "another base"), (delta.size_number(40) + delta.size_number(9) + b"\x91\x28\x09", "beyond")):
        with pytest.raises(ValueError, match=said):
            delta.apply_delta(base, bad)


def test_long_copy():
    base = bytes(range(256)) * 1024
    assert delta.apply_delta(base, delta.size_number(len(base)) + delta.size_number(0x10000) + b"\x80") == base[:0x10000]
