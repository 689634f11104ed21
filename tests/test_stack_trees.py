"""Split tables of all shards probed at once against shards one by one."""

import numpy as np

from quern.operators.cuckoo import CuckooTree, IncrementalCuckoo
from quern.operators.static_filters import Cuckoo, Stack

KEYS = np.random.default_rng(5).integers(0, 1 << 60, 6_000)
SHARD = KEYS % 7


def test_a_stack_of_split_tables_with_what_waits():
    trees = {k: CuckooTree(4, 8) for k in range(6)}
    for k, tree in trees.items():
        tree.insert_all(KEYS[SHARD == k][: 60 * (k + 1)].view(np.uint64))
    assert {tree.depth for tree in trees.values()} == {3, 5} and any(tree.full for tree in trees.values())
    stack = Stack(IncrementalCuckoo(16), {k: tree.state() for k, tree in trees.items()})
    one = np.zeros(len(KEYS), bool)
    for k, tree in trees.items():
        one[SHARD == k] = tree.contains_all(KEYS[SHARD == k].view(np.uint64))
    assert (stack.probe(SHARD, KEYS) == one).all() and not one.all()
    assert Cuckoo(4, 8).places(KEYS)[1].max() < 4
