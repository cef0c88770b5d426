"""A bounded cache for values of repeated keys inside one Python worker."""

from __future__ import annotations


class TwoGenerationCache:
    """Keeps at most ``2 * generation`` entries: when the young generation is full it
    replaces the old one, and entries met again move back to the young one. Frequent keys
    therefore stay, whatever the number of rare ones."""

    def __init__(self, generation: int):
        self.generation = generation
        self.young: dict = {}
        self.old: dict = {}

    def renew(self) -> None:
        """Make room; call between documents."""
        if len(self.young) >= self.generation:
            self.old, self.young = self.young, {}

    def missing(self, keys) -> list:
        """Keys without a value, each once; old entries met are kept young."""
        young, old, out = self.young, self.old, []
        for k in dict.fromkeys(keys):
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out
