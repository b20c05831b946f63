"""The counter's calls to its state."""

import pandas as pd

from siftwork.streaming.stores import _Counter


class _Held(dict):
    asked = 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def updateValue(self, key, value):
        self[key] = value


class _Size:
    n = None

    def exists(self):
        return self.n is not None

    def get(self):
        return self.n

    def update(self, n):
        self.n = n


def test_a_value_is_asked_for_once():
    c = _Counter(None)
    c.seen, c.size = _Held(), _Size()
    batch = lambda *rows: next(c.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["ord", "key", "type", "tier", "reset"])]), None))
    assert list(batch((1, "a", "T", 1, False), (2, "b", "T", 2, False), (3, "a", "T", 1, False))["index"]) == [1, 2] and c.seen.asked == 0
    assert list(batch((4, "a", "T", 1, False), (5, "a", "T", 1, False), (6, "c", "T", 2, False), (7, None, "T", 2, True), (8, "a", "T", 1, False))["index"]) == [3, 1] and c.seen.asked == 2
