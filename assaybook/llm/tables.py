"""A bounded table of values computed once for each distinct key."""

from __future__ import annotations


class Distinct(dict):
    """``table[key]`` is ``compute(key)``, computed when first asked for.

    Two generations of at most ``most`` keys each: a full young one becomes the
    old one, and keys found in the old one move up. Frequent keys stay, memory
    is bounded, and the values do not depend on what is remembered. Keys longer
    than ``longest`` are computed each time.
    """

    def __init__(self, compute, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
