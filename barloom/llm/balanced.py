"""A balanced search tree (AA tree) of ordered keys, with the least key that is not below a bound."""

from __future__ import annotations


class _Node:
    __slots__ = ("key", "level", "left", "right")

    def __init__(self, key):
        self.key, self.level, self.left, self.right = key, 1, None, None


def _skew(t):
    if t is not None and t.left is not None and t.left.level == t.level:
        left = t.left
        t.left, left.right = left.right, t
        return left
    return t


def _split(t):
    if t is not None and t.right is not None and t.right.right is not None and t.right.right.level == t.level:
        right = t.right
        t.right, right.left = right.left, t
        right.level += 1
        return right
    return t


class Tree:
    """Distinct keys; ``add``, ``remove`` and ``at_least`` take logarithmic time."""

    def __init__(self):
        self._root, self._size = None, 0

    def __len__(self) -> int:
        return self._size

    def add(self, key) -> None:
        self._root = self._added(self._root, key)
        self._size += 1

    def _added(self, t, key):
        if t is None:
            return _Node(key)
        if key == t.key:
            raise ValueError(f"{key!r} is there already")
        if key < t.key:
            t.left = self._added(t.left, key)
        else:
            t.right = self._added(t.right, key)
        return _split(_skew(t))

    def remove(self, key) -> None:
        self._root = self._removed(self._root, key)
        self._size -= 1

    def _removed(self, t, key):
        if t is None:
            raise KeyError(key)
        if key < t.key:
            t.left = self._removed(t.left, key)
        elif key > t.key:
            t.right = self._removed(t.right, key)
        elif t.right is not None:
            after = t.right
            while after.left is not None:
                after = after.left
            t.key, t.right = after.key, self._removed(t.right, after.key)
        else:
            return t.left
        # a level may have become too high; at most three skews and two splits restore it
        low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
        if low < t.level:
            t.level = low
            if t.right is not None and t.right.level > low:
                t.right.level = low
        t = _skew(t)
        t.right = _skew(t.right)
        if t.right is not None:
            t.right.right = _skew(t.right.right)
        t = _split(t)
        t.right = _split(t.right)
        return t

    def at_least(self, bound):
        """The least key >= bound, None without one."""
        t, found = self._root, None
        while t is not None:
            if t.key < bound:
                t = t.right
            else:
                found, t = t.key, t.left
        return found
