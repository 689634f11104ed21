"""Shards probed at once against shards one by one."""

import numpy as np
import pytest

from quern.operators.static_filters import BinaryFuse, CuckooFilter, Ribbon, Stack, Xor

KEYS = np.random.default_rng(5).integers(0, 1 << 60, 6_000)
SHARD = KEYS % 7


@pytest.mark.parametrize("filter_", [BinaryFuse(), BinaryFuse(16), Xor(), Xor(16), Ribbon(), Ribbon(16, 128), CuckooFilter()])
def test_a_stack_tells_what_its_shards_tell(filter_):
    held = {k: KEYS[:3_000][SHARD[:3_000] == k][: 40 * (k + 1)] for k in range(6)}  # of several sizes; the seventh is not there
    states = {k: filter_.build(x) for k, x in held.items()}
    stack, calls = Stack(filter_, states), []
    one = np.zeros(len(KEYS), bool)
    for k, state in states.items():
        one[SHARD == k] = filter_.probe(state, KEYS[SHARD == k])
    stack.told, told = (lambda state, h: calls.append(len(h)) or told(state, h)), stack.told
    assert (stack.probe(SHARD, KEYS) == one).all() and len(calls) == 1
    assert all(stack.probe(np.full(len(x), k), x).all() for k, x in held.items())
    assert not Stack(filter_, {}).probe(SHARD, KEYS).any()
