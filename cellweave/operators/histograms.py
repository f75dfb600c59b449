"""Working with collected histograms: the bins of rf_tile_histogram and agg_approx_histogram."""

from __future__ import annotations

from collections.abc import Sequence


class CellHistogram:
    """Bins of (value, count), in order of the value."""

    def __init__(self, bins: Sequence):
        self.bins = sorted(((b["value"], b["count"]) if not isinstance(b, tuple) or hasattr(b, "asDict") else b) for b in bins)

    @property
    def labels(self) -> list[float]:
        return [v for v, _ in self.bins]

    @property
    def total_count(self) -> int:
        return sum(n for _, n in self.bins)

    def item_count(self, label: float) -> int:
        return dict(self.bins).get(label, 0)

    @property
    def mean(self) -> float:
        return sum(v * n for v, n in self.bins) / self.total_count

    @property
    def mode(self) -> float:
        return max(self.bins, key=lambda b: (b[1], -b[0]))[0]

    @property
    def median(self) -> float:
        return self.quantiles([0.5])[0]

    def quantiles(self, shares: Sequence[float]) -> list[float]:
        """Values at shares of the counts, linear between bins."""
        total, ends, at = self.total_count, [], 0
        for v, n in self.bins:
            at += n
            ends.append((at / total, v))
        out = []
        for p in shares:
            before = None
            for share, v in ends:
                if share >= p:
                    out.append(v if before is None else before[1] + (v - before[1]) * (p - before[0]) / (share - before[0]))
                    break
                before = (share, v)
            else:
                out.append(ends[-1][1])
        return out

    def quantile_breaks(self, breaks: int) -> list[float]:
        return self.quantiles([i / (breaks + 1) for i in range(1, breaks + 1)])

    def ascii(self, width: int = 40) -> str:
        most = max(n for _, n in self.bins)
        return "\n".join(f"{v:12g} {n:8d} {'*' * max(1, round(width * n / most))}" for v, n in self.bins)
