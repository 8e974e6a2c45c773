"""A bounded memory of what distinct strings map to."""

from __future__ import annotations


class Memory(dict):
    """Keeps the first ``most`` entries, which frequent keys are among; starts anew once many times as many were refused.

    Keys longer than ``longest`` are never kept, so the memory is bounded in bytes too.
    """

    def __init__(self, most: int, longest: int):
        super().__init__()
        self.most, self.longest, self.refused = most, longest, 0

    def keep(self, key, value):
        if len(key) > self.longest:
            return value
        if len(self) < self.most:
            self[key] = value
        else:
            self.refused += 1
            if self.refused > 8 * self.most:
                self.clear()
                self.refused = 0
        return value
