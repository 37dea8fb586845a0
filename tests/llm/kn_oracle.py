"""Brute-force interpolated modified Kneser-Ney model over Python dictionaries."""

import functools
import math
import re
from collections import Counter, defaultdict


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0] + [min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


class Oracle:
    def __init__(self, texts, order):
        self.order = order
        self.plain = Counter()
        levels = {order: Counter()}
        for text in texts:
            ts = tokens(text)
            self.plain.update(ts)
            padded = ["<begin>"] * (order - 1) + ts
            for i in range(len(ts)):
                levels[order][tuple(padded[i : i + order])] += 1
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        self.levels = levels
        self.d = {n: discounts(list(c.values())) for n, c in levels.items()}
        self.heads = {}
        for n, c in levels.items():
            heads = defaultdict(list)
            for g, k in c.items():
                heads[g[:-1]].append(k)
            self.heads[n] = heads
        self.total = sum(self.plain.values())

    @functools.cache
    def of_head(self, n, head):
        """Total, and what is left to the level below."""
        counts = self.heads[n][head]
        return sum(counts), sum(self.d[n][min(k, 3)] for k in counts) / sum(counts)

    def p(self, gram):
        if not gram:
            return 1 / (len(self.plain) + 1)
        n = len(gram)
        below = self.p(gram[1:])
        head = self.heads[n].get(gram[:-1])
        if not head:
            return below
        d, c = self.d[n], self.levels[n].get(gram, 0)
        t, gamma = self.of_head(n, gram[:-1])
        return max(c - d[min(c, 3)], 0) / t + gamma * below

    def row(self, text):
        ts = tokens(text)
        padded = ["<begin>"] * (self.order - 1) + ts
        v = len(self.plain)
        return {
            "n_tokens": len(ts), "n_known": sum(self.plain[t] > 0 for t in ts), "train_tokens": self.total,
            "base_score": sum(math.log10((self.plain[t] + 0.1) / (self.total + 0.1 * (v + 1))) for t in ts),
            "score": sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(ts))),
        }
